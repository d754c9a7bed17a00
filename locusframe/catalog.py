"""All registered queries over the genotype fixture and their SQL.

SQL is kept next to the query it checks. ``G`` is the fixture as SQL; common steps are
WITH parts. Statistics are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.fixtures import GENO_SQL, geno_view, table
from locusframe.functions import bases as B
from locusframe.operators import coding, convert, diversity, fourpop, intervals, ld, merge, pairs, sites, spectra, summary, windows
from locusframe.plans import analyses
from locusframe.streaming.windows import windowed_values

FLAGSHIP = "fst_windows"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SITE = ["scaffold", "position"]
W = 1000

G = GENO_SQL.format(part="part", nation="nation")
#: WITH parts by name, in the order in which they build on one another.
PARTS = {
    "g": G,
    "c": """SELECT scaffold, position, count(*) FILTER (WHERE allele = 0) AS n_a, count(*) FILTER (WHERE allele = 1) AS n_c,
      count(*) FILTER (WHERE allele = 2) AS n_g, count(*) FILTER (WHERE allele = 3) AS n_t, count(allele) AS called, count(*) AS haps
      FROM g GROUP BY scaffold, position""",
    "cp": """SELECT scaffold, position, pop, count(*) FILTER (WHERE allele = 0) AS n_a, count(*) FILTER (WHERE allele = 1) AS n_c,
      count(*) FILTER (WHERE allele = 2) AS n_g, count(*) FILTER (WHERE allele = 3) AS n_t, count(allele) AS called, count(*) AS haps
      FROM g GROUP BY scaffold, position, pop""",
    "gt": """SELECT scaffold, position, sample, pop, count(allele) AS n_called, count(*) AS ploidy, count(DISTINCT allele) AS d,
      min(allele) AS lo, max(allele) AS hi, max(CASE WHEN hap = 0 THEN allele END) AS a0, max(CASE WHEN hap = 1 THEN allele END) AS a1
      FROM g GROUP BY scaffold, position, sample, pop""",
    "cm": """SELECT scaffold, position, count(*) FILTER (WHERE n_called = ploidy) AS full_calls,
      count(*) FILTER (WHERE d + (CASE WHEN n_called < ploidy THEN 1 ELSE 0 END) > 1) AS het_calls, count(*) AS n_samples FROM gt GROUP BY scaffold, position""",
    "m": """SELECT c.*, full_calls, het_calls, (CASE WHEN n_a > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_c > 0 THEN 1 ELSE 0 END)
      + (CASE WHEN n_g > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_t > 0 THEN 1 ELSE 0 END) AS n_alleles,
      list_sort([n_a, n_c, n_g, n_t], 'DESC')[2] AS second FROM c JOIN cm USING (scaffold, position)""",
    "last": "SELECT scaffold, max(position) AS last FROM g GROUP BY scaffold",
    "sites": "SELECT DISTINCT scaffold, position FROM g",
    "win": f"""SELECT scaffold, k, k * {W} + 1 AS start, k * {W} + {W} AS "end" FROM (SELECT scaffold, unnest(range(0, CAST(greatest(0, ceil((last - {W}) / {W}.0)) AS BIGINT) + 1)) AS k FROM last)""",
    "hp": "SELECT DISTINCT sample * 2 + hap AS h, pop FROM g",
    "pr": f"""SELECT a.scaffold, (a.position - 1) // {W} AS k, a.sample * 2 + a.hap AS a, b.sample * 2 + b.hap AS b, a.pop AS pa, b.pop AS pb,
      count(*) AS called, count(*) FILTER (WHERE a.allele <> b.allele) AS diff FROM g a JOIN g b ON a.scaffold = b.scaffold AND a.position = b.position
      AND a.sample * 2 + a.hap < b.sample * 2 + b.hap WHERE a.allele IS NOT NULL AND b.allele IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6""",
    "pp": "SELECT scaffold, k, least(pa, pb) AS x, greatest(pa, pb) AS y, sum(diff / called) AS sd, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4",
}
_NEEDS = {"c": "g", "cp": "g", "gt": "g", "cm": "gt", "m": "c cm", "last": "g", "sites": "g", "win": "last", "hp": "g", "pr": "g", "pp": "pr"}


def sql(needs: str, body: str, **more: str) -> str:
    """A query over the named WITH parts; ``more`` gives further ones."""
    want: list[str] = []

    def add(n):
        for x in _NEEDS.get(n, "").split():
            add(x)
        if n not in want:
            want.append(n)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({PARTS[n]})" for n in want] + [f"{n} AS ({x})" for n, x in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def query(oracle: str | None = None):
    """Registers a function of the genotype calls (and spark, sf_dir)."""

    def deco(f):
        def run(spark, sf_dir):
            return f(geno_view(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ints(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "tinyint", "smallint") else F.col(c) for c, t in df.dtypes])


# ---- projections, filters ---------------------------------------------------------


@query(sql("g", "SELECT scaffold, position, sample, hap, allele FROM g WHERE sample IN (3, 7)"))
def project_samples(g, *_):
    return g.where(F.col("sample").isin(3, 7)).select(*SITE, "sample", "hap", "allele")


@query(sql("c", "SELECT scaffold, position, called FROM c WHERE scaffold IN ('scaf0', 'scaf1', 'scaf2') AND scaffold NOT IN ('scaf1')"))
def scaffold_filter(g, *_):
    return sites.site_counts(g.where(F.col("scaffold").isin("scaf0", "scaf1", "scaf2") & ~F.col("scaffold").isin("scaf1"))).select(*SITE, "called")


REGIONS = "SELECT concat('scaf', CAST(s_suppkey % 5 AS VARCHAR(4))) AS scaffold, CAST(s_suppkey * 37 AS BIGINT) AS start, CAST(s_suppkey * 37 + 40 + s_suppkey % 90 AS BIGINT) AS {end}, concat('r', CAST(s_suppkey AS VARCHAR(12))) AS wname FROM supplier"


def _regions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    return s.select(F.concat(F.lit("scaf"), (k % 5).cast("string")).alias("scaffold"), (k * 37).alias("start"), (k * 37 + 40 + k % 90).alias("end"), F.concat(F.lit("r"), k.cast("string")).alias("wname"))


REG = REGIONS.format(end='"end"')


@query(sql("sites", 'SELECT scaffold, position FROM sites WHERE EXISTS (SELECT 1 FROM reg r WHERE r.scaffold = sites.scaffold AND position BETWEEN start AND "end")', reg=REG))
def region_semi(g, spark, sf_dir):
    return intervals.points_in_intervals(g.select(*SITE).distinct(), _regions(spark, sf_dir), how="left_semi")


@query(sql("m", "SELECT scaffold, position, full_calls FROM m WHERE full_calls >= 23"))
def filter_min_calls(g, *_):
    return sites.filter_sites(g, min_calls=23).select(*SITE, "full_calls")


@query(sql("m", "SELECT scaffold, position, CAST(n_alleles AS BIGINT) AS n_alleles FROM m WHERE full_calls >= 1 AND n_alleles BETWEEN 2 AND 2"))
def filter_alleles(g, *_):
    return sites.filter_sites(g, min_alleles=2, max_alleles=2).select(*SITE, "n_alleles")


@query(sql("m", "SELECT scaffold, position, second FROM m WHERE full_calls >= 1 AND n_alleles >= 1 AND (n_alleles = 1 OR second >= 5)"))
def filter_mac(g, *_):
    return sites.filter_sites(g, min_var_count=5).select(*SITE, "second")


@query(sql("m", "SELECT scaffold, position, round(het_calls / full_calls, 6) AS het FROM m WHERE full_calls >= 1 AND het_calls / full_calls <= 0.4"))
def filter_max_het(g, *_):
    return rounded(sites.filter_sites(g, max_het=0.4).select(*SITE, "het"))


@query(sql("m", "SELECT scaffold, position, round(second / called, 6) AS second_freq FROM m WHERE full_calls >= 1 AND n_alleles >= 1 AND (n_alleles = 1 OR second / called BETWEEN 0.1 AND 0.45)"))
def filter_freq(g, *_):
    return rounded(sites.filter_sites(g, min_freq=0.1, max_freq=0.45).select(*SITE, "second_freq"))


def _hwe(by: str = "") -> dict[str, str]:
    """WITH parts up to ``hp_``: p of the exact test per biallelic site (and ``by``)."""
    keys = f"scaffold, position{by}"
    return {
        "hx": f"SELECT *, min(lo) OVER w AS l, max(hi) OVER w AS u FROM gt WHERE n_called = 2 AND ploidy = 2 WINDOW w AS (PARTITION BY {keys})",
        "ht": f"""SELECT {keys}, count(*) FILTER (WHERE d = 2) AS het, count(*) FILTER (WHERE d = 1 AND lo = l) AS hom1, count(*) FILTER (WHERE d = 1 AND lo = u) AS hom2
          FROM hx GROUP BY {keys} HAVING min(l) < max(u) AND bool_and(lo IN (l, u) AND hi IN (l, u))""",
        "hw": """SELECT *, list_transform(range(rare % 2, rare + 1, 2), lambda h: h * ln(2) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma((n2 - rare - h) // 2 + 1)) AS ws
          FROM (SELECT *, 2 * least(hom1, hom2) + het AS rare, 2 * (het + hom1 + hom2) AS n2 FROM ht)""",
        "hp_": f"""SELECT {keys}, het, hom1, hom2, list_sum(list_transform(list_filter(ws, lambda x: x <= ws[(het - rare % 2) // 2 + 1] + 1e-9), lambda x: exp(x))) / list_sum(list_transform(ws, lambda x: exp(x))) AS p FROM hw""",
    }


@query(sql("gt", "SELECT scaffold, position, het, hom1, hom2, round(p, 6) AS p FROM hp_", **_hwe()))
def hwe_test(g, *_):
    return rounded(sites.hwe_test(g))


@query(
    sql(
        "m",
        """SELECT scaffold, position FROM m WHERE full_calls >= 1 AND n_alleles >= 2 AND NOT EXISTS (SELECT 1 FROM hp_ WHERE hp_.scaffold = m.scaffold AND hp_.position = m.position AND p <= 0.2)
        AND EXISTS (SELECT 1 FROM pc WHERE pc.scaffold = m.scaffold AND pc.position = m.position)""",
        **_hwe(", pop"),
        pc="SELECT scaffold, position FROM (SELECT scaffold, position, pop, count(*) FILTER (WHERE n_called = ploidy) AS n FROM gt GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(n) >= 4",
    )
)
def filter_hwe(g, *_):
    return analyses.filter_genotypes(g, hwe_p=0.2, populations={"min_pop_calls": 4}, min_alleles=2).select(*SITE).distinct()


_POPK = """SELECT scaffold, position, pop, called, n_a, n_c, n_g, n_t, (CASE WHEN n_a > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_c > 0 THEN 1 ELSE 0 END)
  + (CASE WHEN n_g > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_t > 0 THEN 1 ELSE 0 END) AS k FROM cp"""
_POPS = """SELECT scaffold, position, min(k) AS min_k, max(k) AS max_k, (CASE WHEN sum(n_a) > 0 THEN 1 ELSE 0 END) + (CASE WHEN sum(n_c) > 0 THEN 1 ELSE 0 END)
  + (CASE WHEN sum(n_g) > 0 THEN 1 ELSE 0 END) + (CASE WHEN sum(n_t) > 0 THEN 1 ELSE 0 END) AS n_alleles,
  greatest(max(n_a / nullif(called, 0)) - min(n_a / nullif(called, 0)), max(n_c / nullif(called, 0)) - min(n_c / nullif(called, 0)), max(n_g / nullif(called, 0)) - min(n_g / nullif(called, 0)),
  max(n_t / nullif(called, 0)) - min(n_t / nullif(called, 0))) AS spread FROM pk GROUP BY scaffold, position"""


@query(sql("gt", "SELECT scaffold, position, min(n) AS min_calls FROM (SELECT scaffold, position, pop, count(*) FILTER (WHERE n_called = ploidy) AS n FROM gt GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(n) >= 4"))
def filter_pop_calls(g, *_):
    return sites.population_filter(g, min_pop_calls=4).select(*SITE, "min_calls")


@query(sql("cp", "SELECT scaffold, position, CAST(n_alleles AS BIGINT) AS n_alleles FROM ps WHERE min_k = 1 AND max_k = 1 AND n_alleles > 1", pk=_POPK, ps=_POPS))
def fixed_diffs(g, *_):
    return sites.population_filter(g, fixed=True).select(*SITE, "n_alleles")


@query(sql("cp", "SELECT scaffold, position, CAST(min_k AS BIGINT) AS min_k, CAST(max_k AS BIGINT) AS max_k FROM ps WHERE min_k >= 1 AND max_k <= 2", pk=_POPK, ps=_POPS))
def filter_pop_alleles(g, *_):
    return sites.population_filter(g, min_pop_alleles=1, max_pop_alleles=2).select(*SITE, "min_k", "max_k")


@query(sql("cp", "SELECT scaffold, position, round(spread, 6) AS spread FROM ps WHERE spread >= 0.8", pk=_POPK, ps=_POPS))
def nearly_fixed(g, *_):
    return rounded(sites.population_filter(g, nearly_fixed=0.8).select(*SITE, "spread"))


_THIN = """WITH RECURSIVE s AS (SELECT scaffold, position, row_number() OVER (PARTITION BY scaffold ORDER BY position) AS rn FROM (SELECT DISTINCT scaffold, position FROM ({g}))),
t AS (SELECT scaffold, rn, position, position AS last, false AS keep FROM s WHERE rn = 1
  UNION ALL SELECT s.scaffold, s.rn, s.position, CASE WHEN s.position - t.last >= 200 THEN s.position ELSE t.last END, s.position - t.last >= 200 FROM t JOIN s ON s.scaffold = t.scaffold AND s.rn = t.rn + 1)
SELECT scaffold, position FROM t WHERE keep"""


@query(_THIN.format(g=G))
def thin_sites(g, *_):
    return sites.thin_sites(g.select(*SITE).distinct(), 200)


@query(sql("gt", "SELECT scaffold, position, sample, CASE WHEN a0 = a1 THEN a0 END AS forced FROM gt"))
def force_ploidy(g, *_):
    return sites.genotypes(g).select(*SITE, "sample", F.get(B.force_ploidy(F.col("alleles"), 1), F.lit(0)).alias("forced"))


@query(sql("g", "SELECT scaffold, position // 500 AS position, min_by(sample, o) AS sample, min_by(allele, o) AS allele FROM (SELECT *, position * 1000 + sample * 2 + hap AS o FROM g WHERE allele IS NOT NULL) GROUP BY 1, 2"))
def dedup_sites(g, *_):
    # coarse positions, so that each site is there many times
    o = F.col("position") * 1000 + F.col("sample") * 2 + F.col("hap")
    rows = g.where("allele is not null").select("scaffold", F.floor(F.col("position") / 500).alias("position"), "sample", "allele", o.alias("o"))
    return merge.dedup_sites(rows, "o").drop("o")


# ---- VCF semantics on rows derived from the fixture --------------------------------

_VCF = """SELECT scaffold AS chrom, position AS pos, CASE WHEN position % 9 = 0 THEN 'ACG' ELSE 'A' END AS ref,
  CASE WHEN position % 5 = 0 THEN [] WHEN position % 7 = 0 THEN ['C', 'CT'] ELSE ['C'] END AS alt, CASE WHEN position % 11 = 0 THEN NULL ELSE CAST(position % 50 AS DOUBLE) END AS qual FROM sites"""


def _vcf(g):
    p = F.col("position")
    gt = lambda s: F.concat(((p * s) % 2).cast("string"), F.when(p % 3 == 0, "|").otherwise("/"), F.when((p + s) % 13 == 0, ".").otherwise(((p + s) % 2).cast("string")))
    call = lambda s: F.struct(F.lit(f"s{s}").alias("sample"), F.create_map(F.lit("GT"), gt(s), F.lit("DP"), F.when((p + s) % 17 == 0, ".").otherwise(((p * s) % 30).cast("string")), F.lit("AD"), F.concat((p % 9).cast("string"), F.lit(","), (p % 8).cast("string"))).alias("fields"))
    return g.select(*SITE).distinct().select(
        F.col("scaffold").alias("chrom"), p.alias("pos"), F.when(p % 9 == 0, "ACG").otherwise("A").alias("ref"),
        F.when(p % 5 == 0, F.array().cast("array<string>")).when(p % 7 == 0, F.array(F.lit("C"), F.lit("CT"))).otherwise(F.array(F.lit("C"))).alias("alt"),
        F.when(p % 11 != 0, (p % 50).cast("double")).alias("qual"), F.array(call(1), call(2)).alias("calls"),
    )


_CALLS = """SELECT chrom, pos, ref, alt, s, (pos * s) % 2 AS i0, CASE WHEN (pos + s) % 13 = 0 THEN NULL ELSE (pos + s) % 2 END AS i1,
  CASE WHEN (pos + s) % 17 = 0 THEN NULL ELSE (pos * s) % 30 END AS dp FROM v, (VALUES (1), (2)) t(s)"""


def _from_vcf(name: str):
    from locusframe.sources import text

    return getattr(text, name)


@query(sql("sites", "SELECT chrom, pos, qual FROM v WHERE (qual IS NULL OR qual >= 20) AND length(ref) <= 1", v=_VCF))
def vcf_filter(g, *_):
    return _from_vcf("filter_vcf")(_vcf(g), 20, 1).select("chrom", "pos", "qual")


@query(sql("sites", "SELECT chrom, pos, CASE WHEN len(alt) = 0 THEN 'MONO' WHEN length(ref) > 1 OR len(alt) = 2 THEN 'INDEL' ELSE 'SNP' END AS site_type FROM v", v=_VCF))
def site_type(g, *_):
    return _vcf(g).select("chrom", "pos", _from_vcf("site_type")().alias("site_type"))


@query(
    sql(
        "sites",
        """SELECT chrom AS scaffold, pos AS position, 's' || s AS sample, CASE WHEN dp IS NULL OR dp < 8 OR i1 IS NULL OR (i0 = 1 AND len(alt) = 0) OR (i1 = 1 AND len(alt) = 0) THEN 'N/N'
        ELSE (CASE WHEN i0 = 1 THEN alt[1] ELSE ref END) || '/' || (CASE WHEN i1 = 1 THEN alt[1] ELSE ref END) END AS gt FROM k""",
        v=_VCF, k=_CALLS,
    )
)
def vcf_gt_filter(g, *_):
    x = _from_vcf("vcf_calls")(_vcf(g), [{"flag": "DP", "min": 8}])
    return x.select(*SITE, "sample", F.translate("gt", "|", "/").alias("gt"))


@query(sql("sites", "SELECT chrom AS scaffold, pos AS position, 's' || s AS sample, CASE WHEN dp IS NULL THEN '.' ELSE CAST(dp AS VARCHAR) END AS value FROM k", v=_VCF, k=_CALLS))
def vcf_field(g, *_):
    return _from_vcf("vcf_field")(_vcf(g), "DP")


@query(sql("sites", "SELECT chrom, pos + i AS pos, substr(ref, CAST(i + 1 AS BIGINT), 1) AS ref FROM (SELECT *, unnest(range(0, length(ref))) AS i FROM v)", v=_VCF))
def expand_multi(g, *_):
    return _from_vcf("expand_multi")(_vcf(g)).select("chrom", "pos", "ref")


# ---- joins --------------------------------------------------------------------------

_GT1 = "SELECT scaffold, position, string_agg(CAST(coalesce(a0, 9) * 10 + coalesce(a1, 9) AS VARCHAR), ' ' ORDER BY sample) AS gt FROM gt GROUP BY 1, 2"


def _three(g):
    x = sites.genotypes(g).select(*SITE, "sample", (F.coalesce(F.get("alleles", F.lit(0)), F.lit(9)) * 10 + F.coalesce(F.get("alleles", F.lit(1)), F.lit(9))).cast("string").alias("gt"))
    x = x.groupBy(*SITE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "gt"))), lambda v: v["gt"]), " ").alias("gt"))
    p = F.col("position")
    return x.where(p % 2 == 0), x.where(p % 3 == 0), x.where(p % 5 != 0)


_TABS = {"x": _GT1, "t0": "SELECT * FROM x WHERE position % 2 = 0", "t1": "SELECT * FROM x WHERE position % 3 = 0", "t2": "SELECT * FROM x WHERE position % 5 <> 0"}


@query(sql("gt", "SELECT scaffold, position, t0.gt AS gt_0, t1.gt AS gt_1, t2.gt AS gt_2 FROM t0 JOIN t1 USING (scaffold, position) JOIN t2 USING (scaffold, position)", **_TABS))
def merge_intersect(g, *_):
    return merge.merge_sites(list(_three(g)))


@query(
    sql(
        "gt",
        """SELECT scaffold, position, coalesce(t0.gt, 'N') AS gt_0, coalesce(t1.gt, 'N') AS gt_1, coalesce(t2.gt, 'N') AS gt_2
        FROM x LEFT JOIN t0 USING (scaffold, position) LEFT JOIN t1 USING (scaffold, position) LEFT JOIN t2 USING (scaffold, position)
        WHERE t0.gt IS NOT NULL AND (t0.gt IS NOT NULL)::INT + (t1.gt IS NOT NULL)::INT + (t2.gt IS NOT NULL)::INT >= 2""",
        **_TABS,
    )
)
def merge_union(g, *_):
    return merge.merge_sites(list(_three(g)), "union", union_min=2, first=1)


@query(
    sql(
        "gt last",
        """SELECT e.scaffold, e.position, coalesce(t0.gt, 'N') AS gt_0, coalesce(t1.gt, 'N') AS gt_1, coalesce(t2.gt, 'N') AS gt_2 FROM (SELECT scaffold, unnest(range(1, last + 1)) AS position FROM last) e
        LEFT JOIN t0 USING (scaffold, position) LEFT JOIN t1 USING (scaffold, position) LEFT JOIN t2 USING (scaffold, position)""",
        **_TABS,
    )
)
def merge_all(g, *_):
    lengths = g.groupBy("scaffold").agg(F.max("position").alias("length"))
    return merge.merge_sites(list(_three(g)), "all", lengths=lengths)


@query(sql("gt", "SELECT scaffold, position, t0.gt AS gt_0 FROM t0 WHERE EXISTS (SELECT 1 FROM t1 WHERE t1.scaffold = t0.scaffold AND t1.position = t0.position)", **_TABS))
def merge_semi(g, *_):
    return merge.merge_sites(list(_three(g))[:2], silent=(1,))


@query(sql("g", "SELECT CAST(n_regionkey AS BIGINT) AS region, count(allele) AS called FROM g JOIN nation ON n_nationkey = sample GROUP BY 1"))
def pop_join(g, spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sample"), F.col("n_regionkey").cast("long").alias("region"))
    return g.drop("pop").join(F.broadcast(n), "sample").groupBy("region").agg(F.count("allele").alias("called"))  # 25 nations


@query(sql("sites", 'SELECT s.scaffold, position, wname FROM sites s JOIN reg r ON r.scaffold = s.scaffold AND position BETWEEN start AND "end"', reg=REG))
def interval_point(g, spark, sf_dir):
    return intervals.points_in_intervals(g.select(*SITE).distinct(), _regions(spark, sf_dir)).select(*SITE, "wname")


_IV = 'SELECT o_orderkey AS id, \'c\' || CAST(o_custkey % 3 AS VARCHAR) AS chrom, (o_orderkey * 13) % 5000 AS start, (o_orderkey * 13) % 5000 + o_custkey % 60 AS "end" FROM orders'
#: All orders, spread so that an interval meets a few others whatever the number of rows.
_IV2 = 'SELECT o_orderkey AS id, \'c\' || CAST(o_custkey % 3 AS VARCHAR) AS chrom, o_orderkey * 7 AS start, o_orderkey * 7 + o_custkey % 60 AS "end" FROM orders'


def _iv2(spark, sf_dir):
    o, s = table(spark, sf_dir, "orders"), F.col("o_orderkey") * 7
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("chrom"), s.alias("start"), (s + F.col("o_custkey") % 60).alias("end"))


def _iv(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = (F.col("o_orderkey") * 13) % 5000
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("chrom"), s.alias("start"), (s + F.col("o_custkey") % 60).alias("end"))


@query(f'SELECT a.id AS a_id, b.id AS b_id FROM ({_IV2}) a JOIN ({_IV2}) b ON a.chrom = b.chrom AND a.start <= b.start AND b."end" <= a."end"')
def interval_contains(g, spark, sf_dir):
    return intervals.pairs_of_intervals(_iv2(spark, sf_dir), _iv2(spark, sf_dir), "contain", 100)


@query(f'SELECT a.id AS a_id, b.id AS b_id FROM ({_IV2}) a JOIN ({_IV2}) b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end"')
def interval_overlap(g, spark, sf_dir):
    return intervals.pairs_of_intervals(_iv2(spark, sf_dir), _iv2(spark, sf_dir), "overlap", 100)


_RED = f"""WITH i AS (SELECT * FROM ({_IV2})), r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS island FROM r)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM n GROUP BY chrom, island"""


@query(_RED)
def interval_reduce(g, spark, sf_dir):
    return intervals.reduce_intervals(_iv2(spark, sf_dir))


_LIFT_T = "SELECT 'n' || CAST(t % 3 AS VARCHAR) AS new_scaf, t * 100 + 1 AS new_start, t * 100 + 80 AS new_end, 'c' || CAST(t % 2 AS VARCHAR) AS scaf, t * 90 + 1 AS start, t * 90 + 80 AS \"end\", CASE WHEN t % 4 = 0 THEN '-' ELSE '+' END AS strand FROM range(0, 60) r(t)"


@query(f"""WITH t AS ({_LIFT_T}), r AS (SELECT id, chrom AS scaf, start, "end" FROM ({_IV}))
SELECT r.id, r.scaf, r.start, r."end", t.new_scaf, CASE WHEN t.strand = '-' THEN t.new_end - (r."end" - t.start) ELSE t.new_start + r.start - t.start END AS new_start,
  CASE WHEN t.strand = '-' THEN t.new_end - (r.start - t.start) ELSE t.new_start + r."end" - t.start END AS new_end, t.strand,
  CASE WHEN t.scaf IS NOT NULL THEN 'OK' WHEN r.scaf IN (SELECT scaf FROM t) THEN 'BROKEN' ELSE 'MISSING' END AS status
FROM r LEFT JOIN t ON t.scaf = r.scaf AND r.start BETWEEN t.start AND t."end" AND r."end" BETWEEN t.start AND t."end" """)
def liftover(g, spark, sf_dir):
    t = F.col("id")
    tr = spark.range(60).select(
        F.concat(F.lit("n"), (t % 3).cast("string")).alias("new_scaf"), (t * 100 + 1).alias("new_start"), (t * 100 + 80).alias("new_end"), F.concat(F.lit("c"), (t % 2).cast("string")).alias("scaf"),
        (t * 90 + 1).alias("start"), (t * 90 + 80).alias("end"), F.when(t % 4 == 0, "-").otherwise("+").alias("strand"),
    )
    return intervals.liftover(_iv(spark, sf_dir).withColumnRenamed("chrom", "scaf"), tr, 1000)


def _assemble_sql():
    place = "CAST(substr(scaffold, 5, 1) AS BIGINT)"
    return f"""SELECT new_scaf, CAST(length(sequence) AS BIGINT) AS n, sha256(sequence) AS digest FROM (
      SELECT 'asm' || sample || '_' || hap AS new_scaf, string_agg(repeat('N', CAST(r * (m + 7) + 4 - coalesce(last, 0) AS BIGINT)) || part, '' ORDER BY r) AS sequence FROM (
        SELECT *, lag(r * (m + 7) + 4 + length(seq)) OVER (PARTITION BY sample, hap ORDER BY r) AS last, CASE WHEN r % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END AS part FROM (
          SELECT *, {place} AS r, max(length(seq)) OVER () AS m FROM sq)) GROUP BY sample, hap)"""


def _assemble(g, spark, sf_dir):
    # every sequence whole, on a new scaffold per haplotype, in places as long as the longest
    seqs = _sequences(g)
    m = seqs.agg(F.max(F.length("seq"))).first()[0] or 0
    name = F.concat_ws("/", "scaffold", F.col("sample").cast("string"), F.col("hap").cast("string"))
    rank, n = F.substring("scaffold", 5, 1).cast("long"), F.length("seq").cast("long")
    p = seqs.select(
        F.concat(F.lit("asm"), F.concat_ws("_", F.col("sample").cast("string"), F.col("hap").cast("string"))).alias("new_scaf"), (rank * (m + 7) + 5).alias("new_start"), (rank * (m + 7) + 4 + n).alias("new_end"),
        name.alias("scaf"), F.lit(1).cast("long").alias("start"), n.alias("end"), F.when(rank % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    out = intervals.assemble(p, seqs.select(name.alias("name"), "seq"))
    return out.select("new_scaf", F.length("sequence").cast("long").alias("n"), F.sha2(F.encode("sequence", "UTF-8"), 256).alias("digest"))


# ---- windows ------------------------------------------------------------------------


def _sites(g):
    return g.select(*SITE).distinct()


@query(sql("win sites", """SELECT w.scaffold, w.k, w.start, w."end", count(s.position) AS sites, CAST(round_even(avg(s.position), 0) AS BIGINT) AS mid FROM win w
  LEFT JOIN sites s ON s.scaffold = w.scaffold AND s.position BETWEEN w.start AND w."end" GROUP BY 1, 2, 3, 4"""))
def wind_coord(g, *_):
    s = _sites(g)
    w = windows.window_summary(windows.coordinate_windows(s, W), windows.in_coordinate_windows(s, W), ["scaffold", "k"])
    return w.select("scaffold", "k", "start", "end", "sites", "mid")


@query(
    sql(
        "last sites",
        """SELECT row_number() OVER (ORDER BY w.scaffold, w.k) AS window_id, w.scaffold, w.start, w.start + 499 AS "end", count(s.position) AS sites
        FROM w LEFT JOIN sites s ON s.scaffold = w.scaffold AND s.position BETWEEN w.start AND w.start + 499 GROUP BY w.scaffold, w.k, w.start""",
        w="SELECT scaffold, k, k * 200 + 1 AS start FROM (SELECT scaffold, unnest(range(0, CAST(greatest(0, ceil((last - 500) / 200.0)) AS BIGINT) + 1)) AS k FROM last)",
    )
)
def wind_coord_sliding(g, *_):
    s = _sites(g)
    w = windows.window_summary(windows.coordinate_windows(s, 500, 200), windows.in_coordinate_windows(s, 500, 200), ["scaffold", "k"])
    return w.select("window_id", "scaffold", "start", "end", "sites")


@query(
    sql(
        "sites",
        """SELECT r.scaffold, i, min(position) AS start, max(position) AS "end", CAST(round_even(avg(position), 0) AS BIGINT) AS mid, count(*) AS sites
        FROM r JOIN w ON w.scaffold = r.scaffold AND rn BETWEEN i * 15 AND i * 15 + 19 GROUP BY 1, 2 HAVING count(*) >= 10""",
        r="SELECT scaffold, position, row_number() OVER (PARTITION BY scaffold ORDER BY position) - 1 AS rn FROM sites",
        w="SELECT scaffold, i FROM (SELECT scaffold, n, unnest(range(0, n)) AS i FROM (SELECT scaffold, count(*) AS n FROM sites GROUP BY 1)) WHERE i = 0 OR i * 15 + 5 < n",
    )
)
def wind_sites(g, *_):
    return windows.site_windows(_sites(g), 20, 5, 10)


@query(
    sql(
        "sites",
        """SELECT r.scaffold, row_number() OVER (PARTITION BY r.scaffold ORDER BY r.a) - 1 AS i, x.position AS start, y.position AS "end", r.z - r.a + 1 AS sites
        FROM step r JOIN s x ON x.scaffold = r.scaffold AND x.rn = r.a JOIN s y ON y.scaffold = r.scaffold AND y.rn = r.z WHERE r.ok""",
        s="SELECT scaffold, position, row_number() OVER (PARTITION BY scaffold ORDER BY position) - 1 AS rn, count(*) OVER (PARTITION BY scaffold) AS n FROM sites",
        reach="SELECT a.scaffold, a.rn AS a, max(b.rn) AS z, max(a.n) AS n FROM s a JOIN s b ON b.scaffold = a.scaffold AND b.rn BETWEEN a.rn AND a.rn + 19 AND b.position - a.position <= 600 GROUP BY 1, 2",
        step="""SELECT scaffold, a, z, n, z - a >= 4 AS ok, CASE WHEN z - a >= 4 THEN z ELSE -1 END AS last FROM reach WHERE a = 0
          UNION ALL SELECT r.scaffold, r.a, r.z, r.n, r.z - r.a >= 4 AND r.z > p.last, CASE WHEN r.z - r.a >= 4 AND r.z > p.last THEN r.z ELSE p.last END
          FROM step p JOIN reach r ON r.scaffold = p.scaffold AND r.a = (CASE WHEN p.ok THEN greatest(p.a + 1, p.z - 4) ELSE p.a + 1 END) WHERE NOT (p.ok AND p.z = p.n - 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def wind_sites_maxdist(g, *_):
    return windows.site_windows_max_distance(_sites(g), 20, 5, 600, 5)


@query(sql("sites", """SELECT wname, r.scaffold, start, "end", count(s.position) AS sites, min(s.position) AS first_site, max(s.position) AS last_site, CAST(round_even(avg(s.position), 0) AS BIGINT) AS mid
  FROM reg r LEFT JOIN sites s ON s.scaffold = r.scaffold AND position BETWEEN start AND "end" GROUP BY 1, 2, 3, 4""", reg=REG))
def wind_predefined(g, spark, sf_dir):
    return windows.predefined_windows(_sites(g), _regions(spark, sf_dir))


@query(sql("sites", """SELECT scaffold, (rn - 1) // 50 AS block, count(*) AS sites, min(position) AS start, max(position) AS "end" FROM
  (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY position) AS rn FROM sites) GROUP BY 1, 2"""))
def wind_blocks(g, *_):
    return windows.blocks(_sites(g), 50)


@query(sql("win sites", """SELECT w.scaffold, w.k, min(s.position) AS first_site, max(s.position) AS last_site, CAST(round_even(avg(s.position), 0) AS BIGINT) AS mid
  FROM win w LEFT JOIN sites s ON s.scaffold = w.scaffold AND s.position BETWEEN w.start AND w."end" GROUP BY 1, 2"""))
def wind_meta(g, *_):
    s = _sites(g)
    w = windows.window_summary(windows.coordinate_windows(s, W), windows.in_coordinate_windows(s, W), ["scaffold", "k"])
    return w.select("scaffold", "k", "first_site", "last_site", "mid")


@query(sql("sites", "SELECT scaffold, (position - m) // 3000 AS block, count(*) AS sites FROM sites JOIN (SELECT scaffold, min(position) AS m FROM sites GROUP BY 1) USING (scaffold) GROUP BY 1, 2"))
def jackknife_blocks(g, *_):
    return windows.jackknife_blocks(_sites(g), 3000).groupBy("scaffold", "block").agg(F.count("*").alias("sites"))


# ---- site aggregates ----------------------------------------------------------------


@query(sql("c", "SELECT * FROM c"))
def base_counts(g, *_):
    return sites.site_counts(g)


@query(sql("cp", "SELECT scaffold, position, pop, round(n_a / nullif(called, 0), 6) AS f_a, round(n_c / nullif(called, 0), 6) AS f_c, round(n_g / nullif(called, 0), 6) AS f_g, round(n_t / nullif(called, 0), 6) AS f_t FROM cp"))
def base_freqs(g, *_):
    return rounded(sites.base_frequencies(sites.site_counts(g, "pop")).select(*SITE, "pop", "f_a", "f_c", "f_g", "f_t"))


_LETTERS = "(CASE WHEN n_a > 0 THEN 'A' ELSE '' END || CASE WHEN n_c > 0 THEN 'C' ELSE '' END || CASE WHEN n_g > 0 THEN 'G' ELSE '' END || CASE WHEN n_t > 0 THEN 'T' ELSE '' END)"
_RANKED = "list_sort(list_filter([{'neg': -n_a, 'b': 0}, {'neg': -n_c, 'b': 1}, {'neg': -n_g, 'b': 2}, {'neg': -n_t, 'b': 3}], lambda x: x.neg < 0))"


@query(sql("c", f"SELECT scaffold, position, {_LETTERS} AS alleles, array_to_string(list_transform({_RANKED}, lambda x: x.b), '') AS ranked FROM c"))
def site_alleles(g, *_):
    ranked = F.array_join(F.transform(sites.ranked_alleles(), lambda x: x["base"].cast("string")), "")
    return sites.site_counts(g).select(*SITE, sites.alleles_text().alias("alleles"), ranked.alias("ranked"))


@query(sql("c", """SELECT scaffold, position, CASE WHEN called = 0 THEN '' ELSE (CASE WHEN n_a = greatest(n_a, n_c, n_g, n_t) THEN 'A' ELSE '' END || CASE WHEN n_c = greatest(n_a, n_c, n_g, n_t) THEN 'C' ELSE '' END
  || CASE WHEN n_g = greatest(n_a, n_c, n_g, n_t) THEN 'G' ELSE '' END || CASE WHEN n_t = greatest(n_a, n_c, n_g, n_t) THEN 'T' ELSE '' END) END AS major FROM c"""))
def major_allele(g, *_):
    return sites.site_counts(g).select(*SITE, sites.major_alleles().alias("major"))


@query(sql("c", """SELECT scaffold, position, CAST(CASE WHEN len(l) = 2 THEN list_sort(list_transform(l, lambda x: {'n': -x.neg, 'b': x.b}))[1].b END AS BIGINT) AS minor
  FROM (SELECT scaffold, position, list_filter([{'neg': -n_a, 'b': 0}, {'neg': -n_c, 'b': 1}, {'neg': -n_g, 'b': 2}, {'neg': -n_t, 'b': 3}], lambda x: x.neg < 0) AS l FROM c)"""))
def minor_allele(g, *_):
    return sites.site_counts(g).select(*SITE, sites.minor_allele().cast("long").alias("minor"))


_DER = """SELECT scaffold, position, list_filter([0, 1, 2, 3], lambda b: o[b + 1] > 0) AS os, list_filter([0, 1, 2, 3], lambda b: i[b + 1] > 0) AS ins FROM
  (SELECT scaffold, position, [coalesce(sum(n_a) FILTER (WHERE pop = 4), 0), coalesce(sum(n_c) FILTER (WHERE pop = 4), 0), coalesce(sum(n_g) FILTER (WHERE pop = 4), 0), coalesce(sum(n_t) FILTER (WHERE pop = 4), 0)] AS o,
  [coalesce(sum(n_a) FILTER (WHERE pop <> 4), 0), coalesce(sum(n_c) FILTER (WHERE pop <> 4), 0), coalesce(sum(n_g) FILTER (WHERE pop <> 4), 0), coalesce(sum(n_t) FILTER (WHERE pop <> 4), 0)] AS i FROM cp GROUP BY 1, 2)"""
_DERIVED = "SELECT scaffold, position, CASE WHEN len(os) = 1 AND len(ins) = 2 AND list_contains(ins, os[1]) THEN CAST(os[1] AS BIGINT) END AS ancestral, CASE WHEN len(os) = 1 AND len(ins) = 2 AND list_contains(ins, os[1]) THEN CAST(list_filter(ins, lambda b: b <> os[1])[1] AS BIGINT) END AS derived FROM d0"


@query(sql("cp", "SELECT * FROM der", d0=_DER, der=_DERIVED))
def derived_allele(g, *_):
    return sites.derived_allele(sites.site_counts(g, "pop"), 4).select(*SITE, "ancestral", "derived")


_IUPAC_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in B.IUPAC.items()) + ") iu(code, letters)"


@query(sql("c", f"SELECT scaffold, position, coalesce(code, 'N') AS consensus FROM (SELECT scaffold, position, {_LETTERS} AS l FROM c) LEFT JOIN {_IUPAC_SQL} ON letters = l"))
def consensus(g, *_):
    return sites.site_counts(g).select(*SITE, B.consensus(sites.alleles_text()).alias("consensus"))


_PI = "(called * (called - 1) - n_a * (n_a - 1) - n_c * (n_c - 1) - n_g * (n_g - 1) - n_t * (n_t - 1)) / nullif(called * (called - 1), 0)"


@query(sql("cp", f"SELECT scaffold, position, pop, round({_PI}, 6) AS pi FROM cp"))
def site_pi(g, *_):
    return rounded(diversity.site_pi_table(g, "pop"))


@query(sql("cm", "SELECT scaffold, position, round(het_calls / nullif(full_calls, 0), 6) AS het FROM cm"))
def site_het(g, *_):
    m = sites.call_metrics(g)
    return rounded(m.select(*SITE, F.try_divide(F.col("het_calls").cast("double"), F.col("full_calls").cast("double")).alias("het")))


@query(sql("m", "SELECT scaffold, count(*) FILTER (WHERE n_alleles = 2) AS bi_sites, count(*) FILTER (WHERE n_alleles > 1) AS var_sites FROM m GROUP BY 1"))
def bi_sites(g, *_):
    c = sites.site_counts(g).withColumn("k", sites.n_alleles())
    return c.groupBy("scaffold").agg(F.count_if(F.col("k") == 2).alias("bi_sites"), F.count_if(F.col("k") > 1).alias("var_sites"))


@query(sql("g", "SELECT sample, hap, count(allele) AS called, count(*) AS total, round(count(allele) / count(*), 6) AS share FROM g GROUP BY 1, 2"))
def missingness(g, *_):
    return rounded(summary.missingness(g, "sample", "hap"))


@query(sql("g", "SELECT pop, " + ", ".join(f"round(count(*) FILTER (WHERE allele = {i}) / count(allele), 6) AS f_{b}" for i, b in enumerate("acgt")) + " FROM g GROUP BY 1"))
def aln_base_freqs(g, *_):
    return rounded(summary.base_composition(g, "pop"))


# ---- pairs and windows statistics ---------------------------------------------------


@query(sql("pr", "SELECT scaffold, k, a, b, called, diff, round(diff / called, 6) AS dist FROM pr"))
def pair_dist(g, *_):
    p = pairs.window_pairs(g, W).where("a < b")
    return rounded(p.withColumn("dist", F.col("diff") / F.col("called")))


@query(sql("pr", "SELECT a, b, CAST(sum(called) AS BIGINT) AS called FROM pr GROUP BY 1, 2"))
def pair_sites(g, *_):
    return pairs.pair_counts(g, [], "").where("a < b").select("a", "b", "called")


@query(sql("pp", "SELECT scaffold, k, x AS pop, round(CASE WHEN 2 * n / 100.0 >= 0.01 THEN sd / n END, 6) AS pi FROM pp WHERE x = y"))
def pi_windows(g, *_):
    return rounded(diversity.pi_by_population(pairs.window_pairs(g, W), analyses.haplotype_pops(g), ["scaffold", "k"]))


@query(sql("pp", "SELECT scaffold, k, x, y, round(sd / n, 6) AS dxy FROM pp WHERE x < y"))
def dxy_windows(g, *_):
    d = diversity.diversity(pairs.window_pairs(g, W), analyses.haplotype_pops(g), ["scaffold", "k"])
    return rounded(d.select("scaffold", "k", "x", "y", "dxy"))


@query(
    sql(
        "pp",
        """SELECT q.scaffold, q.k, q.x, q.y, round(a.sd / a.n, 6) AS pi_x, round(b.sd / b.n, 6) AS pi_y, round(q.sd / q.n, 6) AS dxy,
        round(1 - (0.5 * a.sd / a.n + 0.5 * b.sd / b.n) / nullif((a.sd + b.sd + q.sd) / (a.n + b.n + q.n), 0), 6) AS fst
        FROM pp q LEFT JOIN pp a ON a.scaffold = q.scaffold AND a.k = q.k AND a.x = q.x AND a.y = q.x LEFT JOIN pp b ON b.scaffold = q.scaffold AND b.k = q.k AND b.x = q.y AND b.y = q.y WHERE q.x < q.y""",
    )
)
def fst_windows(g, *_):
    return rounded(diversity.diversity(pairs.window_pairs(g, W), analyses.haplotype_pops(g), ["scaffold", "k"]))


@query(sql("pr", "SELECT scaffold, k, a // 2 AS s1, b // 2 AS s2, round(avg(diff / called), 6) AS dist FROM pr GROUP BY 1, 2, 3, 4"))
def ind_pair_dist(g, *_):
    return rounded(pairs.individual_pairs(pairs.window_pairs(g, W), ["scaffold", "k"]))


@query(sql("gt", f"SELECT scaffold, (position - 1) // {W} AS k, sample, count(*) FILTER (WHERE n_called = 2) AS sites, round(count(*) FILTER (WHERE n_called = 2 AND d = 2) / nullif(count(*) FILTER (WHERE n_called = 2), 0), 6) AS het FROM gt GROUP BY 1, 2, 3"))
def ind_het(g, *_):
    return rounded(pairs.heterozygosity(windows.in_coordinate_windows(g, W), ["scaffold", "k"]))


_HARM = "list_sum(list_transform(range(1, CAST({n} AS BIGINT)), lambda i: 1.0 / i{p}))"
_THETA = {
    "ok": "SELECT scaffold, position FROM cp GROUP BY 1, 2 HAVING bool_and(called = haps)",
    "th": f"SELECT scaffold, (position - 1) // {W} AS k, pop, count(*) AS l, max(haps) AS n, count(*) FILTER (WHERE {_PI} <> 0) AS s, sum({_PI}) AS theta_pi FROM cp JOIN ok USING (scaffold, position) GROUP BY 1, 2, 3",
    "ha": f"SELECT *, {_HARM.format(n='n', p='')} AS a1, {_HARM.format(n='n', p=' / i')} AS a2 FROM th",
}


@query(sql("cp", "SELECT scaffold, k, pop, l, s, round(theta_pi, 6) AS theta_pi, round(s / a1, 6) AS theta_w FROM ha", **_THETA))
def theta_stats(g, *_):
    return rounded(diversity.theta_stats(windows.in_coordinate_windows(g, W), ["scaffold", "k"]).drop("taj_d"))


@query(
    sql(
        "cp",
        """SELECT scaffold, k, pop, round(CASE WHEN s > 0 THEN (theta_pi - s / a1) / sqrt(((n + 1) / (3.0 * (n - 1)) - 1 / a1) / a1 * s
        + (2.0 * (n * n + n + 3) / (9.0 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * s * (s - 1)) END, 6) AS taj_d FROM ha""",
        **_THETA,
    )
)
def tajima_d(g, *_):
    return rounded(diversity.theta_stats(windows.in_coordinate_windows(g, W), ["scaffold", "k"]).select("scaffold", "k", "pop", "taj_d"))


@query(
    sql(
        "g",
        """SELECT scaffold, k, pop, round(h1, 6) AS h1, round(h1 + 2 * n[1] * coalesce(n[2], 0) / (t * t), 6) AS h12, round(h1 - n[1] * n[1] / (t * t), 6) AS h2
        FROM (SELECT scaffold, k, pop, n, t, list_sum(list_transform(n, lambda v: v * v / (t * t))) AS h1 FROM z)""",
        full="SELECT scaffold, position FROM g GROUP BY 1, 2 HAVING bool_and(allele IS NOT NULL)",
        hs=f"SELECT scaffold, (position - 1) // {W} AS k, pop, sample, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY position) AS x FROM g JOIN full USING (scaffold, position) GROUP BY 1, 2, 3, 4, 5",
        hn="SELECT scaffold, k, pop, x, count(*) AS n FROM hs GROUP BY 1, 2, 3, 4",
        z="SELECT scaffold, k, pop, list(CAST(n AS DOUBLE) ORDER BY n DESC) AS n, CAST(sum(n) AS DOUBLE) AS t FROM hn GROUP BY 1, 2, 3",
    ).replace("full AS", '"full" AS').replace("JOIN full", 'JOIN "full"')
)
def hap_h12(g, *_):
    return rounded(diversity.exact_haplotypes(windows.in_coordinate_windows(g, W), ["scaffold", "k"]))


@query()
def hap_clusters(g, *_):
    p, pops = pairs.window_pairs(g, W), analyses.haplotype_pops(g)
    return rounded(diversity.haplotype_stats(p, pops, ["scaffold", "k"], "scaffold string, k long", 0.1))


@query(sql("pr", "SELECT a // 2 AS s1, b // 2 AS s2, round(avg(d), 6) AS dist FROM (SELECT a, b, sum(diff) / sum(called) AS d FROM pr GROUP BY 1, 2) GROUP BY 1, 2"))
def dist_matrix(g, *_):
    return rounded(analyses.distance_matrices(g))


@query(
    sql(
        "pr hp",
        """SELECT al.scaffold, al.k, s1, s2, round(CASE WHEN ok.k IS NOT NULL THEN sum(w * d) / sum(w) END, 6) AS dist FROM al LEFT JOIN ok ON ok.scaffold = al.scaffold AND ok.k = al.k GROUP BY al.scaffold, al.k, ok.k, s1, s2""",
        oc=f"SELECT scaffold, (position - 1) // {W} AS k, sample * 2 + hap AS h, count(allele) AS n FROM g GROUP BY 1, 2, 3",
        ok="SELECT scaffold, k FROM oc WHERE n >= 17 GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM hp)",
        al="SELECT scaffold, k, a // 2 AS s1, b // 2 AS s2, diff / called AS d, CASE WHEN a // 2 = b // 2 THEN 2 ELSE 1 END AS w FROM pr UNION ALL SELECT scaffold, k, h // 2, h // 2, 0.0, 1 FROM oc WHERE n > 0",
    )
)
def dist_windows_gated(g, *_):
    return rounded(analyses.distance_matrices(g, W, min_per_ind=17, same=True))


_LDV = {
    "w": f"SELECT scaffold, (position - 1) // {W} AS k, position, sample * 2 + hap AS h, allele FROM g WHERE allele IS NOT NULL",
    "j": "SELECT a.scaffold, a.k, a.position AS pos_a, b.position AS pos_b, a.allele AS x, b.allele AS y FROM w a JOIN w b ON a.scaffold = b.scaffold AND a.k = b.k AND a.h = b.h AND a.position < b.position",
    "q": "SELECT scaffold, k, pos_a, pos_b, list(x) AS xs, list(y) AS ys, count(*) AS n FROM j GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT x) = 2 AND count(DISTINCT y) = 2",
}


@query(
    sql(
        "g",
        """SELECT scaffold, k, pos_a, pos_b, n, round(d, 6) AS d, round(d / CASE WHEN d < 0 THEN greatest(-pa * pb, -(1 - pa) * (1 - pb)) ELSE least(pa * (1 - pb), (1 - pa) * pb) END, 6) AS d_prime,
        round(d / sqrt(pa * (1 - pa) * pb * (1 - pb)), 6) AS r, round(d * d / (pa * (1 - pa) * pb * (1 - pb)), 6) AS r2
        FROM (SELECT *, pab - pa * pb AS d FROM (SELECT *, len(list_filter(xs, lambda v: v = ra)) / n AS pa, len(list_filter(ys, lambda v: v = rb)) / n AS pb,
        len(list_filter(range(1, n + 1), lambda i: xs[i] = ra AND ys[i] = rb)) / n AS pab FROM
        (SELECT *, CASE WHEN 2 * len(list_filter(xs, lambda v: v = list_min(xs))) >= n THEN list_min(xs) ELSE list_max(xs) END AS ra,
        CASE WHEN 2 * len(list_filter(ys, lambda v: v = list_min(ys))) >= n THEN list_min(ys) ELSE list_max(ys) END AS rb FROM q)))""",
        **_LDV,
    )
)
def ld_pairs(g, *_):
    x = g.withColumn("k", F.floor((F.col("position") - 1) / W))
    return rounded(ld.ld_pairs(x, ["k"]).select("scaffold", "k", "pos_a", "pos_b", "n", "d", "d_prime", "r", "r2"))


ORACLES["ld_matrix"] = f"SELECT scaffold, pos_a, pos_b, r2 FROM ({ORACLES['ld_pairs']})"


@query(ORACLES["ld_matrix"])
def ld_matrix(g, *_):
    x = g.withColumn("k", F.floor((F.col("position") - 1) / W))
    return rounded(ld.ld_pairs(x, ["k"]).select("scaffold", "pos_a", "pos_b", "r2"))


@query()
def max_ld_phase(g, *_):
    x = g.withColumn("k", F.floor((F.col("position") - 1) / W))
    return ld.max_ld_phase(x, ["scaffold", "k"], "scaffold string, k long")


# ---- frequencies, spectra, patterns -------------------------------------------------


@query(sql("cp", "SELECT scaffold, position, pop, n_a || ',' || n_c || ',' || n_g || ',' || n_t AS value FROM cp"))
def freq_base_counts(g, *_):
    return spectra.frequency_table(g)


_PICK = "CASE {w} WHEN 0 THEN n_a WHEN 1 THEN n_c WHEN 2 THEN n_g WHEN 3 THEN n_t END"


_MI = """SELECT scaffold, position, CASE WHEN len(l) = 2 THEN list_sort(list_transform(l, lambda x: {'n': -x.neg, 'b': x.b}))[1].b END AS minor
  FROM (SELECT scaffold, position, list_filter([{'neg': -n_a, 'b': 0}, {'neg': -n_c, 'b': 1}, {'neg': -n_g, 'b': 2}, {'neg': -n_t, 'b': 3}], lambda x: x.neg < 0) AS l FROM c)"""


@query(sql("cp c", f"SELECT scaffold, position, pop, round(CASE WHEN cp.called >= 0.5 * cp.haps THEN {_PICK.format(w='minor')} / nullif(called, 0) END, 6) AS value FROM cp JOIN mi USING (scaffold, position)", mi=_MI))
def freq_minor(g, *_):
    return rounded(spectra.frequency_table(g, "minor", min_data=0.5))


@query(sql("g c", "SELECT scaffold, position, sample, round(count(*) FILTER (WHERE allele = minor) / nullif(count(allele), 0), 6) AS value FROM g JOIN mi USING (scaffold, position) WHERE minor IS NOT NULL GROUP BY 1, 2, 3", mi=_MI))
def freq_individuals(g, *_):
    return rounded(spectra.frequency_table(g, "minor", by="sample", keep_empty=False))


@query(sql("cp", f"SELECT scaffold, position, pop, round({_PICK.format(w='derived')} / nullif(called, 0), 6) AS value FROM cp JOIN der USING (scaffold, position)", d0=_DER, der=_DERIVED))
def freq_derived(g, *_):
    return rounded(spectra.frequency_table(g, "derived", outgroup=4))


def _targets_sql(pops: list[int], outgroup: int | None = None) -> dict[str, str]:
    everyone = ", ".join(map(str, [*pops, *([outgroup] if outgroup is not None else [])]))
    inside = ", ".join(map(str, pops))
    tot = lambda where: "[" + ", ".join(f"count(*) FILTER (WHERE allele = {b} AND pop IN ({where}))" for b in range(4)) + "]"
    s0 = f"SELECT scaffold, position, {tot(everyone)} AS t, {tot(inside)} AS i, {tot(str(outgroup if outgroup is not None else -1))} AS o, " + ", ".join(f"{tot(str(p))} AS p{n}" for n, p in enumerate(pops))
    s0 += f" FROM g WHERE pop IN ({everyone}) GROUP BY 1, 2 HAVING bool_and(allele IS NOT NULL)"
    some = lambda x: f"len(list_filter({x}, lambda v: v > 0))"
    if outgroup is not None:
        tt = f"SELECT *, list_filter([1, 2, 3, 4], lambda b: i[b] > 0 AND o[b] = 0)[1] AS f FROM s0 WHERE {some('t')} BETWEEN 1 AND 2 AND {some('o')} = 1"
    else:
        r = "list_sort(list_filter([{'neg': -i[1], 'b': 1}, {'neg': -i[2], 'b': 2}, {'neg': -i[3], 'b': 3}, {'neg': -i[4], 'b': 4}], lambda x: x.neg < 0))"
        tt = f"SELECT *, CASE WHEN r[1].neg = r[2].neg THEN least(r[1].b, r[2].b) ELSE r[2].b END AS f FROM (SELECT *, {r} AS r FROM s0 WHERE {some('t')} BETWEEN 1 AND 2)"
    return {"s0": s0, "tt": tt, "tg": "SELECT scaffold, position, " + ", ".join(f"coalesce(p{n}[f], 0) AS n_{n}" for n in range(len(pops))) + " FROM tt"}


@query(sql("g", "SELECT n_0, count(*) AS sites FROM tg GROUP BY 1", **_targets_sql([0])))
def sfs_1d(g, *_):
    return spectra.sfs(spectra.target_counts(g, [0]), [0])


@query(sql("g", "SELECT n_0, n_1, count(*) AS sites FROM tg GROUP BY 1, 2", **_targets_sql([0, 2])))
def sfs_2d(g, *_):
    return spectra.sfs(spectra.target_counts(g, [0, 2]), [0, 1])


@query(sql("g", "SELECT n_0, n_1, n_2, count(*) AS sites FROM tg GROUP BY 1, 2, 3", **_targets_sql([0, 1, 2], 4)))
def sfs_polarized(g, *_):
    return spectra.sfs(spectra.target_counts(g, [0, 1, 2], 4), [0, 1, 2])


@query(sql("g", 'SELECT wname, n_0, n_1, count(*) AS sites FROM tg JOIN reg ON reg.scaffold = tg.scaffold AND position BETWEEN start AND "end" GROUP BY 1, 2, 3', reg=REG, **_targets_sql([0, 2])))
def sfs_regions(g, spark, sf_dir):
    return analyses.frequency_spectrum(g, [0, 2], regions=_regions(spark, sf_dir))


@query(sql("g", "SELECT n_0, n_1, n_2, count(*) AS sites FROM tg GROUP BY GROUPING SETS ((n_0, n_1), (n_0, n_2), (n_1, n_2))", **_targets_sql([0, 1, 2])))
def sfs_pairs(g, *_):
    return spectra.all_spectra(spectra.target_counts(g, [0, 1, 2]), 3, 2)


@query()
def sfs_subsample_individuals(g, *_):
    return spectra.sfs(spectra.subsample_individuals(g, [0, 1], 3), [0, 1])


@query()
def sfs_subsample(g, *_):
    return spectra.sfs(spectra.subsample_counts(g, [0, 1], 6), [0, 1])


@query(
    sql(
        "c g",
        "SELECT pattern, count(*) AS sites FROM pt GROUP BY 1",
        rk=f"SELECT scaffold, position, list_transform({_RANKED}, lambda x: x.b) AS o FROM c WHERE called = haps",
        gs="SELECT scaffold, position, sample, string_agg(CAST(list_position(o, allele) - 1 AS VARCHAR), '' ORDER BY list_position(o, allele)) AS gg FROM g JOIN rk USING (scaffold, position) GROUP BY 1, 2, 3",
        pt="SELECT scaffold, position, string_agg(gg, ' ' ORDER BY sample) AS pattern FROM gs GROUP BY 1, 2",
    ).replace("FROM c WHERE called", "FROM (SELECT scaffold, position, count(*) FILTER (WHERE allele = 0) AS n_a, count(*) FILTER (WHERE allele = 1) AS n_c, count(*) FILTER (WHERE allele = 2) AS n_g, count(*) FILTER (WHERE allele = 3) AS n_t, count(allele) AS called, count(*) AS haps FROM g GROUP BY 1, 2) WHERE called")
)
def genotype_patterns(g, *_):
    return spectra.genotype_patterns(g)


# ---- summaries ----------------------------------------------------------------------

_Q = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS q{p}" for p in summary.QUANTILES)


@query(f"""SELECT event_type, (epoch(ts) - epoch(TIMESTAMP '2024-01-01')) // 86400 AS k, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS sd, round(sum(value), 6) AS sum, {_Q} FROM events GROUP BY 1, 2""".replace(
    "(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) // 86400 AS k", "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS k"
))
def window_stats(g, spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 86400))
    return rounded(summary.window_stats(e, ["event_type", "k"], "value"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most
  FROM events GROUP BY 1, 2, 3""")
def event_windows(g, spark, sf_dir):
    return rounded(windowed_values(table(spark, sf_dir, "events"), "1 day"))


_FP = {
    "f0": "SELECT scaffold, position, " + ", ".join(f"count(*) FILTER (WHERE pop = {p} AND allele = {b}) AS p{i}_{b}" for i, p in enumerate((0, 1, 2, 4), 1) for b in range(4)) + ", "
    + ", ".join(f"count(allele) FILTER (WHERE pop = {p}) AS c{i}" for i, p in enumerate((0, 1, 2, 4), 1)) + " FROM g WHERE pop IN (0, 1, 2, 4) GROUP BY 1, 2",
    "f1": "SELECT *, " + ", ".join(f"p1_{b} + p2_{b} + p3_{b} + p4_{b} AS t_{b}" for b in range(4)) + " FROM f0",
    "f2": "SELECT *, list_filter([0, 1, 2, 3], lambda b: [t_0, t_1, t_2, t_3][b + 1] > 0 AND [p4_0, p4_1, p4_2, p4_3][b + 1] = 0)[1] AS focal FROM f1 WHERE len(list_filter([t_0, t_1, t_2, t_3], lambda v: v > 0)) = 2 AND c1 > 0 AND c2 > 0 AND c3 > 0 AND c4 > 0",
    "f": f"SELECT scaffold, (position - 1) // {W} AS k, position, " + ", ".join(f"[p{i}_0, p{i}_1, p{i}_2, p{i}_3][focal + 1] / c{i} AS p{i}" for i in range(1, 5)) + " FROM f2 WHERE focal IS NOT NULL",
}


def _f4(a, b, c, d):
    return f"((1 - {a}) * {b} * {c} * (1 - {d}) - {a} * (1 - {b}) * {c} * (1 - {d}))"


def _f4c(a, b, c, d):
    return f"({_f4(a, b, c, d)} + {_f4(f'(1 - {a})', f'(1 - {b})', f'(1 - {c})', f'(1 - {d})')})"


_PD = "greatest(p2, p3)"
_M = ("(CASE WHEN p1 > p2 AND p3 > p1 THEN p3 ELSE p1 END)", "(CASE WHEN p1 <= p2 AND p3 > p2 THEN p3 ELSE p2 END)", "(CASE WHEN p1 > p2 AND p3 > p1 THEN -p3 WHEN p1 <= p2 AND p3 > p2 THEN p3 WHEN p1 > p2 THEN -p1 ELSE p2 END)")
_ABBA, _BABA = "((1 - p1) * p2 * p3 * (1 - p4))", "(p1 * (1 - p2) * p3 * (1 - p4))"


@query(
    sql(
        "g",
        f"""SELECT scaffold, k, count(*) AS sites_used, round(sum({_ABBA}), 6) AS ABBA, round(sum({_BABA}), 6) AS BABA, round(sum({_f4('p1', 'p2', 'p3', 'p4')}) / nullif(sum({_ABBA} + {_BABA}), 0), 6) AS D,
        round(sum({_f4('p1', 'p2', 'p3', 'p4')}) / nullif(sum({_f4('p1', _PD, _PD, 'p4')}), 0), 6) AS fd, round(sum({_f4('p1', 'p2', 'p3', 'p4')}) / nullif(sum({_f4(*_M, 'p4')}), 0), 6) AS fdM FROM f GROUP BY 1, 2""",
        **_FP,
    )
)
def abba_baba(g, *_):
    f = windows.in_coordinate_windows(fourpop.frequencies(g, (0, 1, 2, 4)), W, None, g.select(*SITE))
    return rounded(fourpop.four_pop(f, ["scaffold", "k"], fourpop.ABBA_BABA, ("abba", "baba")))


_HULL = ", ".join(_f4c(*x) for x in (("p1", "p3", "p3", "p4"), ("p4", "p2", "p3", "p4"), ("p3", "p2", "p3", "p4"), ("p1", "p4", "p3", "p4")))
_HULL2 = ", ".join(_f4c(*x) for x in (("p1", "p2", "p2", "p4"), ("p1", "p2", "p3", "p1"), ("p1", "p2", "p1", "p4"), ("p1", "p2", "p3", "p2")))
_DENS = {
    "D": f"{_ABBA} + {_BABA}", "D_new": f"{_ABBA} + {_BABA} + p1 * (1 - p2) * (1 - p3) * p4 + (1 - p1) * p2 * (1 - p3) * p4", "fd": _f4("p1", _PD, _PD, "p4"), "fd_c": _f4c("p1", _PD, _PD, "p4"),
    "fdM": _f4(*_M, "p4"), "fdM_c": _f4c(*_M, "p4"), "fhom": _f4("p1", "p3", "p3", "p4"), "fhom_c": _f4c("p1", "p3", "p3", "p4"),
    "fdh": f"greatest({_HULL})", "fdh2": f"greatest({_HULL}, {_HULL2})", "fh": "greatest(abs(p1 - p2), abs(p3 - p4)) * greatest(abs(p1 - p2), abs(p3 - p4))",
}


@query(
    sql(
        "g",
        f"SELECT scaffold, count(*) AS sites_used, round(sum({_ABBA}), 6) AS ABBA, round(sum({_BABA}), 6) AS BABA, round(sum((1 - p1) * p2 * (1 - p3) * (1 - p4)), 6) AS ABAA, round(sum(p1 * (1 - p2) * (1 - p3) * (1 - p4)), 6) AS BAAA, "
        + ", ".join(f"round(sum({_f4('p1', 'p2', 'p3', 'p4') if fourpop.RATIOS[s][0] == 'n_f4' else _f4c('p1', 'p2', 'p3', 'p4')}) / nullif(sum({d}), 0), 6) AS {s}" for s, d in _DENS.items())
        + " FROM f GROUP BY 1",
        **_FP,
    )
)
def four_pop(g, *_):
    return rounded(fourpop.four_pop(fourpop.frequencies(g, (0, 1, 2, 4)), ["scaffold"]))


@query(
    sql(
        "g",
        """SELECT scaffold, count(*) AS n, round(avg(ps), 6) AS mean, round(var_samp(ps), 6) AS var, round(stddev_samp(ps), 6) AS sd, round(stddev_samp(ps) / sqrt(count(*)), 6) AS se
        FROM (SELECT scaffold, n * sx / nullif(sy, 0) - (n - 1) * (sx - x) / nullif(sy - y, 0) AS ps FROM (SELECT *, sum(x) OVER (PARTITION BY scaffold) AS sx, sum(y) OVER (PARTITION BY scaffold) AS sy, count(*) OVER (PARTITION BY scaffold) AS n FROM bl)) GROUP BY 1""",
        **_FP,
        m0="SELECT scaffold, min(position) AS m FROM f GROUP BY 1",
        bl=f"SELECT scaffold, (position - m) // 2000 AS block, sum({_f4('p1', 'p2', 'p3', 'p4')}) AS x, sum({_ABBA} + {_BABA}) AS y FROM f JOIN m0 USING (scaffold) GROUP BY 1, 2",
    )
)
def jackknife(g, *_):
    f = windows.jackknife_blocks(fourpop.frequencies(g, (0, 1, 2, 4)), 2000)
    t = fourpop.terms()
    b = f.groupBy("scaffold", "block").agg(F.sum(t["n_f4"]).alias("x"), F.sum(t["d_d"]).alias("y"))
    return rounded(summary.jackknife_ratio(b, ["scaffold"], "x", "y"))


@query(
    sql(
        "pr hp g",
        """SELECT scaffold, k, h, CASE WHEN x[2].d IS NULL OR x[2].d - x[1].d >= 0.02 THEN x[1].p ELSE -1 END AS painted, round(x[1].d, 6) AS dist FROM
        (SELECT scaffold, k, h, list_sort(list({'d': d, 'p': p})) AS x FROM (SELECT scaffold, k, h, p, avg(d) AS d FROM al GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""",
        al=f"""SELECT scaffold, k, a AS h, pb AS p, diff / called AS d FROM pr UNION ALL SELECT scaffold, k, b, pa, diff / called FROM pr
        UNION ALL SELECT DISTINCT scaffold, (position - 1) // {W}, sample * 2 + hap, pop, 0.0 FROM g WHERE allele IS NOT NULL""",
    )
)
def paint_delta(g, *_):
    return rounded(analyses.paint(g, W, delta=0.02))


@query()
def paint_ranksum(g, *_):
    return analyses.paint(g, W)


@query()
def window_trees(g, *_):
    d = pairs.individual_pairs(pairs.window_pairs(g, 10 * W), ["scaffold", "k"])
    return summary.window_trees(d, ["scaffold", "k"], "scaffold string, k long")


@query(sql("g", f"""SELECT scaffold, k, haplotypes, min_called, snps FROM
  (SELECT scaffold, k, count(*) AS haplotypes, min(n) AS min_called FROM (SELECT scaffold, (position - 1) // {10 * W} AS k, sample, hap, count(allele) AS n FROM g GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
  JOIN (SELECT scaffold, k, count(*) FILTER (WHERE d > 1) AS snps FROM (SELECT scaffold, (position - 1) // {10 * W} AS k, position, count(DISTINCT allele) FILTER (WHERE sample NOT IN (0, 1)) AS d FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2)
  USING (scaffold, k)"""))
def tree_window_gates(g, *_):
    return summary.tree_window_gates(windows.in_coordinate_windows(g, 10 * W), ["scaffold", "k"], (0, 1))


@query()
def window_trees_bootstrap(g, *_):
    return analyses.trees_by_window(g, 10 * W, min_sites=10, min_per_ind=5, min_snps=5, outgroup=(0,), bootstraps=2)


# ---- scalar functions ---------------------------------------------------------------


def _sequences(g):
    """A sequence per scaffold and haplotype: its letters in site order."""
    return convert.window_sequences(g, "scaffold", stretch=convert.STRETCH).select("scaffold", "sample", "hap", "seq")


_SEQ = "SELECT scaffold, sample, hap, string_agg(CASE allele WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE 'N' END, '' ORDER BY position) AS seq FROM g GROUP BY 1, 2, 3"
_LET = "CASE {a} WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE 'N' END"


@query(sql("gt", f"SELECT scaffold, position, sample, CASE WHEN a0 IS NULL OR a1 IS NULL THEN 'N' ELSE code END AS code FROM gt LEFT JOIN {_IUPAC_SQL} ON letters = CASE WHEN a0 = a1 THEN substr('ACGT', a0 + 1, 1) ELSE substr('ACGT', least(a0, a1) + 1, 1) || substr('ACGT', greatest(a0, a1) + 1, 1) END"))
def iupac_codes(g, *_):
    a = F.col("alleles")
    return sites.genotypes(g).select(*SITE, "sample", B.diploid_code(sites.letter(F.get(a, F.lit(0))), sites.letter(F.get(a, F.lit(1)))).alias("code"))


@query(sql("g", "SELECT scaffold, sample, hap, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM sq", sq=_SEQ))
def rev_complement(g, *_):
    return _sequences(g).select("scaffold", "sample", "hap", B.reverse_complement(F.col("seq")).alias("rc"))


_EXP = {
    "e": f"SELECT scaffold, (row_number() OVER (PARTITION BY scaffold ORDER BY position) - 1) // 3 AS k, position, coalesce(code, 'N') AS code, CASE WHEN l = '' THEN 'ACGT' ELSE l END AS l FROM (SELECT scaffold, position, {_LETTERS} AS l FROM c) LEFT JOIN {_IUPAC_SQL} ON letters = l",
    "t": "SELECT scaffold, k, string_agg(code, '' ORDER BY position) AS seq, list(l ORDER BY position) AS ls FROM e GROUP BY 1, 2",
}


@query(sql("c", """SELECT scaffold, k, seq, string_agg(x || y || z, ',' ORDER BY x || y || z) AS all_seqs FROM (SELECT *, unnest(CASE WHEN len(ls) > 2 THEN string_split(ls[3], '') ELSE [''] END) AS z FROM
  (SELECT *, unnest(CASE WHEN len(ls) > 1 THEN string_split(ls[2], '') ELSE [''] END) AS y FROM (SELECT *, unnest(string_split(ls[1], '')) AS x FROM t))) GROUP BY 1, 2, 3""", **_EXP))
def expand_iupac(g, *_):
    # a text of n ambiguous letters stands for up to 4^n others; every site is in a text of three
    c = windows.ranked(sites.site_counts(g).select(*SITE, B.consensus(sites.alleles_text()).alias("code")))
    t = c.groupBy("scaffold", F.floor(F.col("rn") / 3).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]), "").alias("seq"))
    return t.select("scaffold", "k", "seq", F.array_join(F.array_sort(B.expand_ambiguity(F.col("seq"))), ",").alias("all_seqs"))


_CODE_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in B.genetic_code().items()) + ") gc(cdn, aa)"


@query(sql("g", f"SELECT scaffold, sample, hap, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM (SELECT scaffold, sample, hap, i, substr(seq, CAST(i * 3 + 1 AS BIGINT), 3) AS cd FROM (SELECT scaffold, sample, hap, seq, unnest(range(0, length(seq) // 3)) AS i FROM sq)) LEFT JOIN {_CODE_SQL} ON cdn = cd GROUP BY 1, 2, 3", sq=_SEQ))
def translate_cds(g, *_):
    return _sequences(g).select("scaffold", "sample", "hap", B.translate(F.col("seq")).alias("protein"))


@query(sql("g", f"SELECT scaffold, sample, hap, count(*) FILTER (WHERE aa = '_' AND i < n - 1) AS stops FROM (SELECT scaffold, sample, hap, i, length(seq) // 3 AS n, substr(seq, CAST(i * 3 + 1 AS BIGINT), 3) AS cd FROM (SELECT scaffold, sample, hap, seq, unnest(range(0, length(seq) // 3)) AS i FROM sq)) LEFT JOIN {_CODE_SQL} ON cdn = cd GROUP BY 1, 2, 3", sq=_SEQ))
def count_stops(g, *_):
    return _sequences(g).select("scaffold", "sample", "hap", B.count_stops(F.col("seq")).alias("stops"))


def _codon_sets(g):
    c = sites.site_counts(g).select(*SITE, sites.alleles_text().alias("b"))
    c = windows.ranked(c).withColumn("codon", F.floor(F.col("rn") / 3))
    return c.groupBy("scaffold", "codon").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "b"))), lambda x: x["b"]).alias("sets")).where("size(sets) = 3")


_SETS = {
    "al": f"SELECT scaffold, position, {_LETTERS} AS b, (row_number() OVER (PARTITION BY scaffold ORDER BY position) - 1) // 3 AS codon FROM c",
    "st": "SELECT scaffold, codon, list(b ORDER BY position) AS s FROM al GROUP BY 1, 2 HAVING count(*) = 3",
    "opt": f"SELECT scaffold, codon, s, count(DISTINCT coalesce(aa, 'X')) AS naa FROM (SELECT *, x || y || z AS cd FROM (SELECT scaffold, codon, s, x, y, unnest(string_split(s[3], '')) AS z FROM (SELECT scaffold, codon, s, x, unnest(string_split(s[2], '')) AS y FROM (SELECT scaffold, codon, s, unnest(string_split(s[1], '')) AS x FROM st)))) LEFT JOIN {_CODE_SQL} ON cdn = cd GROUP BY 1, 2, 3",
}


@query(sql("c", "SELECT scaffold, codon, CASE WHEN len(list_filter(s, lambda v: length(v) = 2)) = 1 AND len(list_filter(s, lambda v: length(v) = 1)) = 2 THEN CASE WHEN naa = 1 THEN 'syn' ELSE 'non' END END AS kind FROM opt", **_SETS))
def syn_non(g, *_):
    return _codon_sets(g).select("scaffold", "codon", B.syn_non(F.col("sets")).alias("kind"))


def _deg_sql(p: int) -> str:
    letters = [f"s[{i + 1}]" for i in range(3)]
    cd = " || ".join("x" if i == p else v for i, v in enumerate(letters))
    ok = " AND ".join(f"length({v}) = 1" for i, v in enumerate(letters) if i != p) + f" AND length({letters[p]}) >= 1"
    return f"SELECT scaffold, codon, {p} AS place, CASE n WHEN 1 THEN 4 WHEN 4 THEN 0 ELSE 2 END AS degeneracy FROM (SELECT scaffold, codon, count(DISTINCT aa) AS n FROM (SELECT scaffold, st.codon, {cd} AS cd FROM st, (VALUES ('A'), ('C'), ('G'), ('T')) v(x) WHERE {ok}) JOIN {_CODE_SQL} ON cdn = cd GROUP BY 1, 2)".replace("SELECT scaffold, codon, count", "SELECT scaffold, codon, count").replace("FROM (SELECT scaffold, st.codon", "FROM (SELECT scaffold, st.codon").replace(f"WHERE {ok}) JOIN", f"WHERE {ok}) q JOIN")


@query(sql("c", "SELECT scaffold, CAST(codon AS BIGINT) AS codon, CAST(place AS BIGINT) AS place, CAST(degeneracy AS BIGINT) AS degeneracy FROM (" + " UNION ALL ".join(_deg_sql(p) for p in range(3)) + ")", **{k: _SETS[k] for k in ("al", "st")}))
def degeneracy(g, *_):
    s = _codon_sets(g)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("place"), B.degeneracy(F.col("sets"), i).cast("long").alias("degeneracy")) for i in range(3)]))
    return s.select("scaffold", "codon", each.alias("x")).select("scaffold", "codon", "x.*").where("degeneracy is not null")


#: Genes along the whole length of all scaffolds: one every 150 positions, on each in turn.
_GENES = "SELECT 'scaf' || CAST(t % 5 AS VARCHAR) AS scaffold, 'm' || CAST(t AS VARCHAR) AS mrna, CASE WHEN t % 2 = 0 THEN '+' ELSE '-' END AS strand, t * 150 + 11 AS s1, t * 150 + 50 AS e1, t * 150 + 81 AS s2, t * 150 + 130 AS e2 FROM (SELECT unnest(range(0, CAST((SELECT max(p_partkey) FROM part) // 15 + 1 AS BIGINT))) AS t)"


def _genes(spark, sf_dir):
    t, n = F.col("id"), table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    piece = lambda a, b: F.struct((t * 150 + a).alias("start"), (t * 150 + b).alias("end"))
    return spark.range((n or 0) // 15 + 1).select(F.concat(F.lit("scaf"), (t % 5).cast("string")).alias("scaffold"), F.concat(F.lit("m"), t.cast("string")).alias("mrna"), F.when(t % 2 == 0, "+").otherwise("-").alias("strand"), F.array(piece(81, 130), piece(11, 50)).alias("cds"))


_CDSP = f"""SELECT scaffold, mrna, strand, position, CASE WHEN strand = '+' THEN row_number() OVER (PARTITION BY mrna ORDER BY position) ELSE row_number() OVER (PARTITION BY mrna ORDER BY position DESC) END - 1 AS i
  FROM (SELECT scaffold, mrna, strand, unnest(range(s1, e1 + 1)) AS position FROM ({_GENES}) UNION ALL SELECT scaffold, mrna, strand, unnest(range(s2, e2 + 1)) FROM ({_GENES}))"""


@query(f"SELECT scaffold, mrna, position, CAST(i // 3 AS BIGINT) AS codon, CAST(i % 3 AS BIGINT) AS place FROM ({_CDSP}) WHERE i < 90")
def cds_positions(g, spark, sf_dir):
    return coding.coding_positions(_genes(spark, sf_dir)).select("scaffold", "mrna", "position", "codon", "place")


_CODING = {
    "al": f"SELECT scaffold, position, {_LETTERS} AS l FROM c",
    "q": f"SELECT p.scaffold, p.mrna || '.' || p.i // 3 AS codon, p.i % 3 AS place, p.position, coalesce(CASE WHEN strand = '-' THEN reverse(translate(l, 'ACGT', 'TGCA')) ELSE l END, '') AS b FROM ({_CDSP}) p LEFT JOIN al USING (scaffold, position) WHERE i < 90",
    "st": "SELECT scaffold, codon, list(b ORDER BY place) AS s FROM q GROUP BY 1, 2",
    "opt": _SETS["opt"],
    "sn": "SELECT scaffold, codon, CASE WHEN len(list_filter(s, lambda v: length(v) = 2)) = 1 AND len(list_filter(s, lambda v: length(v) = 1)) = 2 THEN CASE WHEN naa = 1 THEN 'syn' ELSE 'non' END END AS kind FROM opt",
    "dg": " UNION ALL ".join(_deg_sql(p) for p in range(3)),
}


@query(sql("c", """SELECT q.scaffold, position, CAST(q.place + 1 AS BIGINT) AS codon_position, CASE WHEN length(b) = 2 THEN kind END AS syn_non, CAST(degeneracy AS BIGINT) AS degeneracy
  FROM q LEFT JOIN sn USING (scaffold, codon) LEFT JOIN dg ON dg.scaffold = q.scaffold AND dg.codon = q.codon AND dg.place = q.place""", **_CODING))
def coding_sites(g, spark, sf_dir):
    letters = sites.site_counts(g).select("scaffold", "position", sites.alleles_text().alias("bases"))
    return ints(coding.coding_sites(_genes(spark, sf_dir), letters))


@query(sql("g", f"""SELECT mrna, sample, hap, string_agg(CASE WHEN strand = '-' THEN translate({_LET.format(a='allele')}, 'ACGTN', 'TGCAN') ELSE {_LET.format(a='allele')} END, '' ORDER BY i) AS sequence FROM
  (SELECT DISTINCT mrna, sample, hap FROM p JOIN g USING (scaffold, position)) JOIN p USING (mrna) LEFT JOIN g USING (scaffold, position, sample, hap) GROUP BY 1, 2, 3""", p=f"SELECT * FROM ({_CDSP}) WHERE i < 90"))
def cds_alignments(g, spark, sf_dir):
    return coding.cds_alignments(_genes(spark, sf_dir), g)


@query(sql("gt", f"SELECT scaffold, position, sample, ({_LET.format(a='a0')}) || '/' || ({_LET.format(a='a1')}) AS phased, CAST(CASE WHEN a0 IS NULL OR a1 IS NULL THEN -1 ELSE (a0 = 2)::INT + (a1 = 2)::INT END AS BIGINT) AS n_g FROM gt"))
def geno_render(g, *_):
    a = F.col("alleles")
    return sites.genotypes(g).select(*SITE, "sample", B.as_phased(a).alias("phased"), B.as_count(a, F.lit(2)).cast("long").alias("n_g"))


@query(sql("gt", f"SELECT scaffold, position, string_agg(({_LET.format(a='a0')}) || '|' || ({_LET.format(a='a1')}), ' ' ORDER BY sample) AS line FROM gt GROUP BY 1, 2"))
def join_haplotypes(g, *_):
    x = sites.genotypes(g)
    return x.groupBy(*SITE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", B.as_phased(F.col("alleles"), "|").alias("p")))), lambda v: v["p"]), " ").alias("line"))


# ---- conversions and selections ------------------------------------------------------


@query(sql("g", _assemble_sql(), sq=_SEQ))
def assemble(g, spark, sf_dir):
    return _assemble(g, spark, sf_dir)


@query(sql("g", "SELECT scaffold, position, sample, hap, allele FROM g WHERE sample NOT IN (0, 11)"))
def exclude_samples(g, *_):
    return convert.select_samples(g, drop=[0, 11]).select(*SITE, "sample", "hap", "allele")


@query(sql("g", f"SELECT scaffold, row_number() OVER (PARTITION BY scaffold, sample, hap ORDER BY position) AS position, sample || '_' || substr('AB', CAST(hap + 1 AS BIGINT), 1) AS name, {_LET.format(a='allele')} AS base FROM g"))
def seq_to_geno(g, *_):
    return convert.sequences_to_sites(_sequences(g).select("scaffold", convert.alternating_name(F.col("sample"), F.col("hap")).alias("name"), "seq"))


@query(sql("g", f"SELECT scaffold, position, string_agg(base, ' ' ORDER BY name) AS line FROM (SELECT scaffold, row_number() OVER (PARTITION BY scaffold, sample, hap ORDER BY position) AS position, sample || '_' || substr('AB', CAST(hap + 1 AS BIGINT), 1) AS name, {_LET.format(a='allele')} AS base FROM g) GROUP BY 1, 2"))
def seq_to_geno_lines(g, *_):
    x = _sequences(g).select("scaffold", convert.alternating_name(F.col("sample"), F.col("hap")).alias("name"), "seq")
    return convert.sequences_to_lines(x).select(*SITE, F.array_join(F.transform("samples", lambda v: v["gt"]), " ").alias("line"))


@query(sql("g", f"SELECT scaffold, (position - 1) // {W} AS k, sample, hap, min(position) AS first_site, max(position) AS last_site, string_agg({_LET.format(a='allele')}, '' ORDER BY position) AS seq FROM g GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"))
def geno_to_seq_windows(g, *_):
    return convert.window_sequences(windows.in_coordinate_windows(g, W), "scaffold", "k", min_sites=2)


@query(sql("g", f"SELECT scaffold, sample, hap, min(position) AS first_site, max(position) AS last_site, string_agg({_LET.format(a='allele')}, '' ORDER BY position) AS seq FROM g GROUP BY 1, 2, 3"))
def geno_to_seq_contigs(g, *_):
    return convert.window_sequences(g, "scaffold", stretch=convert.STRETCH)


@query(sql("g", """SELECT sample, hap, scaffold || ':' || a || '-' || z || ':' || o AS name, CASE WHEN o = '-' THEN reverse(translate(s, 'ACGTN', 'TGCAN')) ELSE s END AS seq FROM
  (SELECT *, substr(seq, CAST(a AS BIGINT), CAST(greatest(0, z - a + 1) AS BIGINT)) AS s FROM (SELECT sq.*, greatest(1, start - 2) AS a, least(length(seq), "end" + 1) AS z, CASE WHEN start % 2 = 0 THEN '-' ELSE '+' END AS o FROM sq JOIN reg USING (scaffold)))""", sq=_SEQ, reg=REG))
def subset_sequences(g, spark, sf_dir):
    r = _regions(spark, sf_dir).select(F.col("scaffold").alias("chrom"), "start", "end", F.when(F.col("start") % 2 == 0, "-").otherwise("+").alias("strand"))
    return convert.subset_sequences(_sequences(g).withColumnRenamed("scaffold", "name"), r, 2, 1).select("sample", "hap", "name", "seq")


_VLIFT = "SELECT 'n' || CAST(t % 3 AS VARCHAR) AS new_scaf, t * 400 + 1 AS new_start, t * 400 + 250 AS new_end, 'scaf' || CAST(t % 4 AS VARCHAR) AS scaf, t * 300 + 1 AS start, t * 300 + 250 AS \"end\", CASE WHEN t % 2 = 0 THEN '-' ELSE '+' END AS strand FROM (SELECT unnest(range(0, CAST((SELECT max(p_partkey) FROM part) // 30 + 1 AS BIGINT))) AS t)"


@query(sql("sites", """SELECT new_scaf AS chrom, CASE WHEN strand = '-' THEN new_end - (pos - start) ELSE new_start + pos - start END AS pos, CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
  array_to_string(list_transform(alt, lambda a: CASE WHEN strand = '-' THEN translate(a, 'ACGT', 'TGCA') ELSE a END), ',') AS alt, qual FROM v JOIN t ON t.scaf = v.chrom AND pos BETWEEN start AND "end" """, v=_VCF, t=_VLIFT))
def vcf_liftover(g, spark, sf_dir):
    t, n = F.col("id"), table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    tr = spark.range((n or 0) // 30 + 1).select(
        F.concat(F.lit("n"), (t % 3).cast("string")).alias("new_scaf"), (t * 400 + 1).alias("new_start"), (t * 400 + 250).alias("new_end"), F.concat(F.lit("scaf"), (t % 4).cast("string")).alias("scaf"),
        (t * 300 + 1).alias("start"), (t * 300 + 250).alias("end"), F.when(t % 2 == 0, "-").otherwise("+").alias("strand"),
    )
    return convert.lift_vcf(_vcf(g), tr).select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual")


_UNION = """SELECT scaffold, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY scaffold ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, max("end") OVER (PARTITION BY scaffold ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reg)) GROUP BY scaffold, island"""


@query(f"""WITH reg AS (SELECT scaffold, start - 150 AS start, "end" + 150 AS "end" FROM ({REG})), u AS ({_UNION}), ge AS (SELECT scaffold, mrna, s1 AS start, e2 AS "end" FROM ({_GENES}))
SELECT scaffold, mrna, start, "end" FROM ge WHERE EXISTS (SELECT 1 FROM u WHERE u.scaffold = ge.scaffold AND u.start <= ge.start AND ge."end" <= u."end")""")
def genes_in_regions(g, spark, sf_dir):
    genes = _genes(spark, sf_dir).select("scaffold", "mrna", F.array_min(F.transform("cds", lambda c: c["start"])).alias("start"), F.array_max(F.transform("cds", lambda c: c["end"])).alias("end"))
    wide = _regions(spark, sf_dir).select("scaffold", (F.col("start") - 150).alias("start"), (F.col("end") + 150).alias("end"))
    return convert.genes_in_regions(genes, wide)


@query(sql("gt", f"SELECT scaffold, position, sample, CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN {_LET.format(a='lo')} ELSE ({_LET.format(a='lo')}) || ({_LET.format(a='hi')}) END AS alleles FROM gt"))
def sample_alleles(g, *_):
    return convert.sample_alleles(g)


@query(sql("sites", "SELECT coalesce(n, scaffold) AS scaffold, position FROM sites LEFT JOIN (VALUES ('scaf0', 'one'), ('scaf3', 'three')) l(o, n) ON o = scaffold"))
def rename_scaffolds(g, spark, *_):
    return convert.rename_scaffolds(g.select(*SITE).distinct(), spark.createDataFrame([("scaf0", "one"), ("scaf3", "three")], "old string, new string"))


@query(sql("sites", "SELECT scaffold, position FROM sites ORDER BY scaffold, position LIMIT 500"))
def first_sites(g, *_):
    return convert.first_sites(g.select(*SITE).distinct(), 500)


@query("SELECT o_custkey AS customer, min(o_orderkey) AS first FROM orders GROUP BY 1")
def unique_in_order(g, spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("o"))
    return convert.unique_in_order(o, "customer", "o")


_PAIRED = {
    "ABAA_BABB": "(1 - p1) * p2 * (1 - p3) * (1 - p4) + p1 * (1 - p2) * p3 * p4", "BAAA_ABBB": "p1 * (1 - p2) * (1 - p3) * (1 - p4) + (1 - p1) * p2 * p3 * p4",
    "ABBA_BAAB": f"{_ABBA} + p1 * (1 - p2) * (1 - p3) * p4", "BABA_ABAB": f"{_BABA} + (1 - p1) * p2 * (1 - p3) * p4",
}


@query(sql("g", "SELECT scaffold, count(*) AS sites_used, " + ", ".join(f"round(sum({v}), 6) AS {k}" for k, v in _PAIRED.items()) + " FROM f GROUP BY 1", **_FP))
def paired_patterns(g, *_):
    return rounded(fourpop.four_pop(fourpop.frequencies(g, (0, 1, 2, 4)), ["scaffold"], (), fourpop.PAIRED))
