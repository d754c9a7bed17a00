"""A deterministic genotype table derived from ``part`` and ``nation``.

Sites are parts, diploid samples nations, populations regions; population 4 is the
outgroup. The text runs in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENO_SQL = """
WITH k AS (SELECT CAST(p_partkey AS BIGINT) k FROM {part}),
s AS (SELECT CAST(n_nationkey AS BIGINT) s, CAST(n_regionkey AS BIGINT) p FROM {nation}),
h AS (SELECT CAST(0 AS BIGINT) h UNION ALL SELECT CAST(1 AS BIGINT) h),
c AS (SELECT k, s, p, h,
  (k*k*31 + k*17 + s*s*7 + s*h*11 + h*5 + k*s*3 + p*k*19 + k*s*h*41) % 101 AS r,
  (k*7 + s*s*13 + k*s*5 + h*h*3) % 97 AS m,
  k % 4 AS ref_b, (k % 4 + 1 + k % 3) % 4 AS alt_b,
  CASE WHEN k % 4 = 0 THEN 0
       WHEN k % 11 = 0 THEN (p % 2) * 101
       WHEN p = 4 AND k % 3 <> 0 THEN 0
       ELSE (k*13 + p*29*(k % 7)) % 100 END AS thr
  FROM k CROSS JOIN s CROSS JOIN h)
SELECT concat('scaf', CAST(k % 5 AS VARCHAR(4))) AS scaffold,
       k*10 + 1 + (k*k) % 7 AS position,
       s AS sample, p AS pop, h AS hap,
       CASE WHEN m < 4 THEN NULL
            WHEN r < thr THEN alt_b
            WHEN k % 23 = 0 AND r > 95 THEN (alt_b + 1) % 4
            ELSE ref_b END AS allele
FROM c
"""


#: Sites that a task of the fixture has; a site has 50 calls, so a task's memory does not grow with the table.
SITES_A_TASK = 4000
_SCAFFOLD, _POSITION = "concat('scaf', CAST(k % 5 AS VARCHAR(4)))", "k*10 + 1 + (k*k) % 7"
#: The same text over sites whose scaffold and position are there already.
_PLACED_SQL = (
    GENO_SQL.replace("SELECT CAST(p_partkey AS BIGINT) k FROM {part}", "SELECT k, scaffold, position FROM {sites}").replace("SELECT k, s, p, h,", "SELECT k, scaffold, position, s, p, h,")
    .replace(f"{_SCAFFOLD} AS scaffold", "scaffold").replace(f"{_POSITION} AS position", "position")
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scaffold, position, sample, pop, hap, allele (0..3 = ACGT, null = missing).

    The two small dimension tables meet each part once; this is how the fixture is
    defined, not a step of any operator. A part is a few bytes but gives 50 calls, so sites
    are dealt out by their number, as a table laid out by site would be: tasks do not grow
    with the table, and aggregations by site find their rows together.
    """
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    n = max(1, -(-k.count() // SITES_A_TASK))
    sites = k.select("k", F.expr(_SCAFFOLD).alias("scaffold"), F.expr(_POSITION).alias("position")).repartition(n, "scaffold", "position")
    return spark.sql(_PLACED_SQL, sites=sites, nation=table(spark, sf_dir, "nation"))
