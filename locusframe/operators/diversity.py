"""Diversity and divergence: pi, dxy, Fst, theta, Tajima's D, haplotype homozygosity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.joins import broadcast_up_to
from locusframe.operators.sites import COUNTS, SITE, site_counts, site_pi


def population_pairs(pairs: DataFrame, pops: DataFrame, keys: list[str], min_sites: int = 1) -> DataFrame:
    """Per window and pair of populations x <= y: sum and number of pair distances.

    ``pops`` (h, pop) may list a haplotype under several populations. Pairs with fewer
    than ``min_sites`` shared sites do not count. ``cells`` is the number of haplotype
    pairs there are.
    """
    x = pops.select(F.col("h").alias("a"), F.col("pop").alias("pa"))
    y = pops.select(F.col("h").alias("b"), F.col("pop").alias("pb"))
    p = pairs.where((F.col("a") < F.col("b")) & (F.col("called") >= min_sites)).join(broadcast_up_to(x), "a").join(broadcast_up_to(y), "b")
    p = p.withColumn("d", F.col("diff") / F.col("called")).withColumn("x", F.least("pa", "pb")).withColumn("y", F.greatest("pa", "pb"))
    return p.groupBy(*keys, "x", "y").agg(F.sum("d").alias("sum_d"), F.count("*").alias("n_d"))


def diversity(pairs: DataFrame, pops: DataFrame, keys: list[str], min_sites: int = 1, min_data: float = 0.01) -> DataFrame:
    """Per window and population pair x < y: pi_x, pi_y, dxy and Fst.

    Means are over the pairs' ratios. pi is null if the pairs that have one fill less
    than ``min_data`` of the n x n block whose diagonal is empty; dxy of the n_x x n_y.
    Fst = 1 - pi_s / pi_t with pi_s weighted by haplotypes and pi_t over all pairs of both.
    """
    size = broadcast_up_to(pops.groupBy("pop").agg(F.count("*").alias("n")))
    p = population_pairs(pairs, pops, keys, min_sites)
    # a window's sums, a row per pair of populations, meet in one map: the pairs are counted once
    p = p.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("x", "y"), F.struct("sum_d", "n_d")))).alias("m"))
    between = p.select(*keys, "m", F.explode(F.filter(F.map_keys("m"), lambda k: k["x"] < k["y"])).alias("_xy")).select(*keys, "m", "_xy.x", "_xy.y")
    of = lambda a, b: F.try_element_at("m", F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    cells = {f"{v}_{n}": of(a, b)[w] for n, a, b in (("x", "x", "x"), ("y", "y", "y"), ("xy", "x", "y")) for v, w in (("sum", "sum_d"), ("n", "n_d"))}
    between = between.select(*keys, "x", "y", *[c.alias(n) for n, c in cells.items()])
    for s in ("x", "y"):
        between = between.join(size.select(F.col("pop").alias(s), F.col("n").alias(f"size_{s}")), s)
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    pi = {s: F.when(2 * c(f"n_{s}") / (c(f"size_{s}") * c(f"size_{s}")) >= min_data, div(c(f"sum_{s}"), c(f"n_{s}"))) for s in ("x", "y")}
    dxy = F.when(c("n_xy") / (c("size_x") * c("size_y")) >= min_data, div(c("sum_xy"), c("n_xy")))
    w = div(c("size_x"), c("size_x") + c("size_y"))
    between = between.select(*keys, "x", "y", pi["x"].alias("pi_x"), pi["y"].alias("pi_y"), dxy.alias("dxy"), w.alias("_w"),
        div(c("sum_x") + c("sum_y") + c("sum_xy"), c("n_x") + c("n_y") + c("n_xy")).alias("_pi_t"))
    return between.select(*keys, "x", "y", "pi_x", "pi_y", "dxy", (1 - F.try_divide(c("_w") * c("pi_x") + (1 - c("_w")) * c("pi_y"), c("_pi_t"))).alias("fst"))


def pi_by_population(pairs: DataFrame, pops: DataFrame, keys: list[str], min_sites: int = 1, min_data: float = 0.01) -> DataFrame:
    size = broadcast_up_to(pops.groupBy("pop").agg(F.count("*").alias("n")))
    p = population_pairs(pairs, pops, keys, min_sites).where("x = y").withColumnRenamed("x", "pop").join(size, "pop")
    return p.select(*keys, "pop", F.when(2 * F.col("n_d") / (F.col("n") * F.col("n")) >= min_data, F.col("sum_d") / F.col("n_d")).alias("pi"))


def _harmonic(n: Column, power: int) -> Column:
    terms = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, i: a + 1.0 / F.pow(i.cast("double"), F.lit(float(power))))


def tajima(n: Column, s: Column, theta_pi: Column) -> Column:
    """Tajima's D of n haplotypes, s segregating sites; null without any."""
    a1, a2, m = _harmonic(n, 1), _harmonic(n, 2), n.cast("double")
    c1 = (m + 1) / (3 * (m - 1)) - 1 / a1
    c2 = 2 * (m * m + m + 3) / (9 * m * (m - 1)) - (m + 2) / (a1 * m) + a2 / (a1 * a1)
    var = c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)
    return F.when((n > 1) & (s > 0) & (var > 0), (theta_pi - s / a1) / F.sqrt(var))


def theta_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per window and population: l, s, theta_pi, theta_w, taj_d over complete sites.

    A site counts if no haplotype of any population is missing. ``calls`` carries the
    window's keys.
    """
    k = [*dict.fromkeys([*keys, *SITE])]
    counts = [F.count_if(F.col("allele") == i).alias(c) for i, c in enumerate(COUNTS)]
    per = calls.groupBy(*k, "pop").agg(*counts, F.count("allele").alias("called"), F.count("*").alias("haps"))
    full = per.groupBy(*k).agg(F.bool_and(F.col("called") == F.col("haps")).alias("ok")).where("ok").drop("ok")
    s = per.join(full, k).withColumn("p", site_pi())
    t = s.groupBy(*keys, "pop").agg(F.count("*").alias("l"), F.max("haps").alias("n"), F.count_if(F.col("p") != 0).alias("s"), F.sum("p").alias("theta_pi"))
    seg = F.col("s").cast("double")
    return t.select(*keys, "pop", "l", "s", "theta_pi", F.when(F.col("n") > 1, F.try_divide(seg, _harmonic(F.col("n"), 1))).alias("theta_w"),
        tajima(F.col("n"), seg, F.col("theta_pi")).alias("taj_d"))


def greedy_clusters(dist: np.ndarray, max_dist: float = 0.0) -> list[int]:
    """Sizes of greedy clusters in the order they are found.

    The row with most others within ``max_dist`` (the first on ties, itself counted)
    takes them all out; when no row has another, the rest are single.
    """
    near = dist <= max_dist
    np.fill_diagonal(near, True)
    live = np.ones(len(dist), bool)
    out = []
    while live.any():
        n = (near & live).sum(1) * live
        i = int(n.argmax())
        if n[i] <= 1:
            return out + [1] * int(live.sum())
        out.append(int(n[i]))
        live &= ~near[i]
    return out


def homozygosity(sizes: list[int]) -> tuple[float, float, float]:
    """H1, H12 and H2 of cluster sizes in discovery order."""
    f = np.array(sizes, float) / sum(sizes)
    h1 = float((f**2).sum())
    return h1, h1 + (2 * float(f[0] * f[1]) if len(f) > 1 else 0.0), h1 - float(f[0] ** 2)


def haplotype_stats(pairs: DataFrame, pops: DataFrame, keys: list[str], types: str, max_dist: float = 0.0) -> DataFrame:
    """H1, H12, H2 per window and population from pair distances."""
    x = pops.select(F.col("h").alias("a"), F.col("pop").alias("pop"))
    y = pops.select(F.col("h").alias("b"), F.col("pop").alias("pop2"))
    p = pairs.join(broadcast_up_to(x), "a").join(broadcast_up_to(y), "b").where("pop = pop2").select(*keys, "pop", "a", "b", (F.col("diff") / F.col("called")).alias("d"))
    names = [*keys, "pop"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        haps = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        m = np.full((len(haps),) * 2, np.inf)
        i, j = np.searchsorted(haps, pdf["a"]), np.searchsorted(haps, pdf["b"])
        m[i, j] = m[j, i] = pdf["d"]
        h = homozygosity(greedy_clusters(m, max_dist))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in names), *h]], columns=[*names, "h1", "h12", "h2"])

    return p.groupBy(*names).applyInPandas(kernel, f"{types}, pop long, h1 double, h12 double, h2 double")


def exact_haplotypes(calls: DataFrame, keys: list[str]) -> DataFrame:
    """H1, H12, H2 for identical haplotypes over sites that nobody misses; no kernel.

    Ties in size do not matter, as the largest classes come first.
    """
    k = [*dict.fromkeys([*keys, *SITE])]
    full = calls.groupBy(*k).agg(F.bool_and(F.col("allele").isNotNull()).alias("ok")).where("ok").drop("ok")
    h = calls.join(full, k).groupBy(*keys, "pop", "sample", "hap").agg(F.array_sort(F.collect_list(F.struct("position", "allele"))).alias("x"))
    n = h.groupBy(*keys, "pop", F.xxhash64("x").alias("x")).agg(F.count("*").alias("n"))
    n = n.groupBy(*keys, "pop").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"), F.sum("n").alias("t"))
    h1 = F.aggregate("n", F.lit(0.0), lambda a, v: a + F.pow(v / F.col("t"), F.lit(2.0)))
    f1, f2 = F.get("n", F.lit(0)) / F.col("t"), F.coalesce(F.get("n", F.lit(1)), F.lit(0)) / F.col("t")
    return n.select(*keys, "pop", h1.alias("h1"), (h1 + 2 * f1 * f2).alias("h12"), (h1 - f1 * f1).alias("h2"))


def site_pi_table(calls: DataFrame, *by: str) -> DataFrame:
    return site_counts(calls, *by).select(*SITE, *by, site_pi().alias("pi"))
