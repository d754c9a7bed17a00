"""Window summaries of numeric site tables, block jackknife, ancestry painting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.pairs import distance_arrays, whole_keys

QUANTILES = (5, 25, 50, 75, 95)


def window_stats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """mean, median, min, max, population sd, sum and quantiles of a column per window.

    NaN counts as missing. Quantiles interpolate linearly.
    """
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    q = [F.percentile(v, p / 100).alias(f"q{p}") for p in QUANTILES]
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("sd"), F.sum(v).alias("sum"), *q
    )


def jackknife_ratio(blocks: DataFrame, keys: list[str], numerator: str, denominator: str) -> DataFrame:
    """Block jackknife of a ratio of sums: n, mean, var, sd, se of the pseudovalues."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x, y = F.col(numerator), F.col(denominator)
    sx, sy, n = F.sum(x).over(w), F.sum(y).over(w), F.count("*").over(w)
    pseudo: Column = n * F.try_divide(sx, sy) - (n - 1) * F.try_divide(sx - x, sy - y)
    p = blocks.select(*keys, pseudo.alias("pseudo"))
    p = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("pseudo").alias("mean"), F.var_samp("pseudo").alias("var"))
    return p.select(*keys, "n", "mean", "var", F.sqrt("var").alias("sd"), (F.sqrt("var") / F.sqrt("n")).alias("se"))


def jackknife(blocks: pd.DataFrame, statistic) -> dict[str, float]:
    """The same for any function of a table of blocks."""
    n, whole = len(blocks), statistic(blocks)
    pseudo = np.array([n * whole - (n - 1) * statistic(blocks.drop(blocks.index[i])) for i in range(n)])
    var = pseudo.var(ddof=1) if n > 1 else float("nan")
    return {"n": n, "mean": pseudo.mean(), "var": var, "sd": var**0.5, "se": (var / n) ** 0.5}


def _reference_distances(pops: DataFrame, n_keys: int):
    """A function of ``pair_rows``: portions as (key columns, haps, dist, members, n, means).

    Members, numbers of distances and their means are by population, in order of ``names``; a
    haplotype's distance to itself counts as 0, and a mean without any is NaN.
    """
    known = pops.distinct().collect()  # a row per haplotype, whose matrix a task holds
    names = np.array(sorted({r["pop"] for r in known}), np.int64)
    of: dict[int, list[int]] = {}
    for r in known:
        of.setdefault(r["h"], []).append(int(np.searchsorted(names, r["pop"])))

    def portions(batches):
        for t in whole_keys(batches, n_keys):
            for keys, haps, dist in distance_arrays(t, n_keys):
                members = np.zeros((len(haps), len(names)))
                for i, h in enumerate(haps.tolist()):
                    members[i, of.get(h, [])] = 1
                n = (~np.isnan(dist)).astype(float) @ members
                with np.errstate(invalid="ignore"):
                    yield keys, haps, dist, members, n, np.nan_to_num(dist) @ members / n

    return names, portions


def _painted(keys: list, haps: np.ndarray, here: np.ndarray, schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of the haplotypes that are ``here`` in a window: keys, h and columns."""
    w, h = np.nonzero(here)
    return pa.RecordBatch.from_arrays([*[k.take(pa.array(w)) for k in keys], pa.array(haps[h]), *[pa.array(c[w, h]) for c in columns]], schema=schema)


def _output(types: str, spark, *columns: tuple) -> tuple[str, pa.Schema]:
    ddl = ", ".join([types, "h long", *[f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in columns]])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    return ddl, pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in spark.createDataFrame([], ddl).schema])


#: Decimal places of a mean distance that count: sums of fractions differ by their order beyond, and ties must not.
PLACES = 12


def paint_delta(rows: DataFrame, pops: DataFrame, keys: list[str], types: str, delta: float, noresult: int = -1) -> DataFrame:
    """Each haplotype's nearest population (the lower on ties), if the second is ``delta`` or more farther.

    ``rows`` are ``pair_rows`` by ``keys``; means are compared to ``PLACES`` places.
    """
    names, portions = _reference_distances(pops, len(keys))
    ddl, schema = _output(types, rows.sparkSession, ("painted", pa.int64()), ("dist", pa.float64()))

    def run(batches):
        for own, haps, _, _, n, mean in portions(batches):
            near = np.where(n > 0, mean.round(PLACES), np.inf)
            best = near.argmin(2)
            first = np.take_along_axis(near, best[..., None], 2)[..., 0]
            np.put_along_axis(near, best[..., None], np.inf, 2)
            with np.errstate(invalid="ignore"):
                sure = (near.min(2) - first).round(PLACES) >= delta
            yield _painted(own, haps, (n > 0).any(2), schema, np.where(sure, names[best], noresult), np.take_along_axis(mean, best[..., None], 2)[..., 0])

    return rows.mapInArrow(run, ddl)


def rank_sum_less(x: np.ndarray, y: np.ndarray) -> float:
    """One-sided rank-sum p (x tends to be less), normal approximation, mean ranks for ties."""
    import math

    both = np.concatenate([x, y])
    order = both.argsort(kind="stable")
    ranks = np.empty(len(both))
    values = both[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    stop = np.append(start[1:], len(values))
    ranks[order] = np.repeat((start + stop + 1) / 2, stop - start)
    n, m = len(x), len(y)
    z = (ranks[:n].sum() - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def paint_rank_sum(rows: DataFrame, pops: DataFrame, keys: list[str], types: str, p_threshold: float = 0.05, noresult: int = -1) -> DataFrame:
    """Nearest population (the lower on ties) if the rank-sum test puts it nearer than every other one.

    ``rows`` are ``pair_rows`` by ``keys``. The rank sum of x among x and y is what it is among
    themselves plus how many y each x exceeds (ties: half), so it is counted by comparisons, for
    many windows at once.
    """
    import math

    names, portions = _reference_distances(pops, len(keys))
    ddl, schema = _output(types, rows.sparkSession, ("painted", pa.int64()))

    def tail(z: np.ndarray) -> np.ndarray:
        some, at = np.unique(z, return_inverse=True)
        return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in some.tolist()])[at].reshape(z.shape)

    def run(batches):
        for own, haps, dist, members, n, mean in portions(batches):
            best = np.where(n > 0, mean.round(PLACES), np.inf).argmin(2)
            sure = np.ones(best.shape, bool)
            for p in range(len(names)):
                mine = np.flatnonzero(members[:, p])
                w, h = np.nonzero((best == p) & (n[..., p] > 0))
                step = max(1, (1 << 21) // max(1, len(mine) * len(haps)))
                for r in (slice(i, i + step) for i in range(0, len(w), step)):
                    d = dist[w[r], h[r]]
                    x = d[:, mine, None]
                    over = ((x > d[:, None, :]).sum(1) + 0.5 * (x == d[:, None, :]).sum(1)) @ members
                    k, m = n[w[r], h[r]][:, [p]], n[w[r], h[r]]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        z = (over - k * m / 2) / np.sqrt(k * m * (k + m + 1) / 12)
                    others = (m > 0) & (np.arange(len(names)) != p)
                    sure[w[r], h[r]] = ((tail(np.where(others, z, 0)) <= p_threshold) | ~others).all(1)
            yield _painted(own, haps, (n > 0).any(2), schema, np.where(sure, names[best], noresult))

    return rows.mapInArrow(run, ddl)


def missingness(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("allele").alias("called"), F.count("*").alias("total"), (F.count("allele") / F.count("*")).alias("share"))


def base_composition(calls: DataFrame, *by: str) -> DataFrame:
    n = F.count("allele")
    return calls.groupBy(*by).agg(*[F.try_divide(F.count_if(F.col("allele") == i).cast("double"), n.cast("double")).alias(f"f_{b}") for i, b in enumerate("acgt")])


def neighbour_joining(names: list[str], dist: np.ndarray) -> str:
    """A Newick tree by neighbour joining; ties (to nine places) go to the first pair."""
    nodes, d = list(names), np.array(dist, float)
    if len(nodes) == 1:
        return f"{nodes[0]};"
    while len(nodes) > 2:
        n = len(nodes)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(q.round(9).argmin(), q.shape))
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        joined = f"({nodes[i]}:{li:.6g},{nodes[j]}:{d[i, j] - li:.6g})"
        rest = [k for k in range(n) if k not in (i, j)]
        new = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], new[:, None]], [new[None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in rest] + [joined]
    return f"({nodes[0]}:{d[0, 1] / 2:.6g},{nodes[1]}:{d[0, 1] / 2:.6g});"


def window_trees(individual: DataFrame, keys: list[str], types: str) -> DataFrame:
    """A neighbour-joining tree per window from sample distances (s1, s2, dist)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf["s1"] != pdf["s2"]].dropna(subset=["dist"])
        s = sorted(set(p["s1"]) | set(p["s2"]))
        m = np.zeros((len(s),) * 2)
        i, j = np.searchsorted(s, p["s1"]), np.searchsorted(s, p["s2"])
        m[i, j] = m[j, i] = p["dist"]
        tree = neighbour_joining([str(x) for x in s], m) if s else ""
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), tree]], columns=[*keys, "newick"])

    return individual.groupBy(*keys).applyInPandas(kernel, f"{types}, newick string")


def tree_window_gates(placed: DataFrame, keys: list[str], outgroup: tuple = ()) -> DataFrame:
    """Per window the haplotypes in it, the fewest sites called in one, and the sites that vary outside ``outgroup`` (samples)."""
    own = placed.groupBy(*keys, "sample", "hap").agg(F.count("allele").alias("n"))
    own = own.groupBy(*keys).agg(F.count("*").alias("haplotypes"), F.min("n").alias("min_called"))
    inner = F.when(~F.col("sample").isin(list(outgroup)), F.col("allele")) if outgroup else F.col("allele")
    vary = placed.groupBy(*dict.fromkeys([*keys, "scaffold", "position"])).agg((F.min(inner) < F.max(inner)).alias("v"))
    return own.join(vary.groupBy(*keys).agg(F.count_if("v").alias("snps")), keys)


def resampled(placed: DataFrame, keys: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """``placed`` with ``replicate`` 1, 2, ...: each draws as many sites of a window as it has, with replacement.

    A drawn site brings all its calls; its position is the window's first plus the number
    of the draw, so that one drawn twice counts twice. Draws hash (seed, replicate, window,
    number), so reruns agree whatever the partitioning. Without replicates there are no rows.
    """
    at = placed.groupBy(*keys).agg(F.array_sort(F.collect_set("position")).alias("at"))
    d = at.withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")))) if replicates else at.limit(0).withColumn("replicate", F.lit(1).cast("long"))
    d = d.select(*keys, "replicate", "at", F.explode(F.sequence(F.lit(0), F.size("at") - 1)).alias("draw"))
    pick = F.pmod(F.xxhash64(F.lit(seed), "replicate", *keys, "draw"), F.size("at")).cast("int")
    d = d.select(*keys, "replicate", F.get("at", pick).alias("position"), (F.get("at", F.lit(0)) + F.col("draw")).alias("drawn"))
    # dealt out by a fixed number: drawn sites pack so well that Spark would merge them into a few large tasks
    n, by = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "position"]
    return placed.repartition(n, *by).join(d.repartition(n, *by), by).drop("position").withColumnRenamed("drawn", "position")
