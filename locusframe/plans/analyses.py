"""The analyses a user starts with: windowed statistics, frequencies, spectra, conversion.

Each is one lazy plan from haplotype calls (scaffold, position, sample, pop, hap, allele).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import convert, diversity, fourpop, pairs, sites, spectra, summary, windows

KEYS = ["scaffold", "k"]
TYPES = "scaffold string, k long"


def haplotype_pops(calls: DataFrame) -> DataFrame:
    return calls.select((F.col("sample") * 2 + F.col("hap")).alias("h"), "pop").distinct()


def _meta(calls: DataFrame, size: int, step: int | None) -> DataFrame:
    s = calls.select("scaffold", "position").distinct()
    return windows.window_summary(windows.coordinate_windows(s, size, step), windows.in_coordinate_windows(s, size, step), KEYS).drop("first_site", "last_site")


def popgen_windows(calls: DataFrame, size: int, step: int | None = None, min_sites: int = 1, min_data: float = 0.01, analyses=("popFreq", "popDist"), failed: bool = False) -> DataFrame:
    """window_id, scaffold, start, end, mid, sites and the chosen statistics, a column each.

    popFreq: l_, S_, thetaPi_, thetaW_, TajD_ per population; popDist: pi_ per population,
    dxy_ and Fst_ per pair; indHet: het_ per sample; indPairDist: d_ per pair of samples;
    hapStats: H1_, H12_, H2_. Windows of fewer than ``min_sites`` sites have nulls and are
    listed only if ``failed``. Statistics do not depend on which others are asked for.
    """
    out = _meta(calls, size, step)
    placed = windows.in_coordinate_windows(calls, size, step)
    pops = haplotype_pops(calls)
    names = [r["pop"] for r in pops.select("pop").distinct().orderBy("pop").collect()]
    good = F.col("sites") >= min_sites

    def wide(df: DataFrame, by: str, values: list, stats: dict[str, str]) -> DataFrame:
        cells = [F.max(F.when(F.col(by) == F.lit(v), F.col(c))).alias(f"{label}_{v}") for v in values for c, label in stats.items()]
        return df.groupBy(*KEYS).agg(*cells)

    parts = []
    if "popFreq" in analyses:
        parts.append(wide(diversity.theta_stats(placed, KEYS), "pop", names, {"l": "l", "s": "S", "theta_pi": "thetaPi", "theta_w": "thetaW", "taj_d": "TajD"}))
    if {"popDist", "hapStats", "indPairDist"} & set(analyses):
        wp = pairs.window_pairs(calls, size, step)
        if "popDist" in analyses:
            parts.append(wide(diversity.pi_by_population(wp, pops, KEYS, min_sites, min_data), "pop", names, {"pi": "pi"}))
            d = diversity.diversity(wp, pops, KEYS, min_sites, min_data).withColumn("xy", F.concat_ws("_", F.col("x").cast("string"), F.col("y").cast("string")))
            parts.append(wide(d, "xy", [f"{a}_{b}" for i, a in enumerate(names) for b in names[i + 1 :]], {"dxy": "dxy", "fst": "Fst"}))
        if "hapStats" in analyses:
            parts.append(wide(diversity.haplotype_stats(wp, pops, KEYS, TYPES), "pop", names, {"h1": "H1", "h12": "H12", "h2": "H2"}))
        if "indPairDist" in analyses:
            ip = pairs.individual_pairs(wp, KEYS)
            both = [tuple(r) for r in ip.select("s1", "s2").distinct().orderBy("s1", "s2").collect()]
            ip = ip.withColumn("xy", F.concat_ws("_", F.col("s1").cast("string"), F.col("s2").cast("string")))
            parts.append(wide(ip, "xy", [f"{a}_{b}" for a, b in both], {"dist": "d"}))
    if "indHet" in analyses:
        h = pairs.heterozygosity(placed, KEYS)
        parts.append(wide(h, "sample", [r["sample"] for r in calls.select("sample").distinct().orderBy("sample").collect()], {"het": "het"}))
    for p in parts:
        stats = [c for c in p.columns if c not in KEYS]
        out = out.join(p, KEYS, "left").withColumns({c: F.when(good, F.col(c)) for c in stats})
    return (out if failed else out.where(good)).drop("k")


def abba_baba_windows(calls: DataFrame, pops: tuple, size: int, step: int | None = None, min_sites: int = 1, min_data: float = 0.0) -> DataFrame:
    """D, fd, fdM, ABBA, BABA and sites used per coordinate window."""
    f = windows.in_coordinate_windows(fourpop.frequencies(calls, pops, min_data), size, step, calls.select("scaffold", "position"))
    s = fourpop.four_pop(f, KEYS, fourpop.ABBA_BABA, ("abba", "baba"), min_sites)
    return _meta(calls, size, step).join(s, KEYS, "left").where(F.col("sites") >= min_sites).drop("k")


def four_pop_windows(calls: DataFrame, pops: tuple, size: int, step: int | None = None, min_sites: int = 1, min_data: float = 0.0, polarize: bool = False, fixed: bool = False) -> DataFrame:
    """All four-population statistics per coordinate window."""
    f = windows.in_coordinate_windows(fourpop.frequencies(calls, pops, min_data, polarize, fixed), size, step, calls.select("scaffold", "position"))
    return _meta(calls, size, step).join(fourpop.four_pop(f, KEYS, min_sites=min_sites), KEYS, "left").where(F.col("sites") >= min_sites).drop("k")


def distance_matrices(calls: DataFrame, size: int | None = None, step: int | None = None, min_per_ind: int = 0, same: bool = False) -> DataFrame:
    """Distances of samples per window, or over all sites: (keys, s1, s2, dist).

    Windows where a haplotype has fewer than ``min_per_ind`` called sites have nulls; ``same``
    as for ``individual_pairs``.
    """
    keys = [] if size is None else KEYS
    wp = pairs.pair_counts(calls, [], "") if size is None else pairs.window_pairs(calls, size, step)
    d = pairs.individual_pairs(wp, keys, same)
    if not min_per_ind:
        return d
    placed = calls if size is None else windows.in_coordinate_windows(calls, size, step)
    good = pairs.enough_sites(placed, keys, haplotype_pops(calls).select("h").distinct().count(), min_per_ind).withColumn("_ok", F.lit(True))
    d = d.join(good, keys, "left") if keys else d.join(F.broadcast(good.limit(1)), F.lit(True), "left")  # a row at most
    return d.withColumn("dist", F.when(F.col("_ok"), F.col("dist"))).drop("_ok")


def paint(calls: DataFrame, size: int, delta: float | None = None, p_threshold: float = 0.05) -> DataFrame:
    """Nearest reference population per haplotype and window, by delta or by rank sum."""
    rows, pops = pairs.tile_rows(calls, size).withColumnRenamed("tile", "k"), haplotype_pops(calls)
    return summary.paint_delta(rows, pops, KEYS, TYPES, delta) if delta is not None else summary.paint_rank_sum(rows, pops, KEYS, TYPES, p_threshold)


def trees_by_window(
    calls: DataFrame, size: int, step: int | None = None, min_sites: int = 1, min_per_ind: int = 0, min_snps: int = 0, outgroup: tuple = (), bootstraps: int = 0, seed: int = 0
) -> DataFrame:
    """scaffold, k, start, end, mid, sites, replicate, newick: a tree per window and bootstrap replicate.

    Trees join neighbours by the distances of samples; replicate 0 is the data, the others draw the
    window's sites with replacement. Windows of fewer than ``min_sites`` sites, where a
    haplotype has fewer than ``min_per_ind`` called sites, or with fewer than ``min_snps``
    sites that vary outside ``outgroup`` (samples) have null trees.
    """
    keys, types = [*KEYS, "replicate"], f"{TYPES}, replicate long"
    meta, placed = _meta(calls, size, step).drop("window_id"), windows.in_coordinate_windows(calls, size, step)
    gates = summary.tree_window_gates(placed, KEYS, outgroup)
    enough = F.col("snps") >= min_snps
    if min_per_ind:
        enough &= (F.col("haplotypes") == haplotype_pops(calls).select("h").distinct().count()) & (F.col("min_called") >= min_per_ind)
    good = meta.where(F.col("sites") >= max(min_sites, 1)).join(gates.where(enough), KEYS).select(*KEYS)
    packed = pairs.site_calls(placed, KEYS).join(good, KEYS, "left_semi")  # a drawn site brings all its calls, so it travels as one row
    every = packed.withColumn("replicate", F.lit(0).cast("long"))
    if bootstraps:
        every = every.unionByName(summary.resampled(packed, KEYS, bootstraps, seed))
    trees = summary.window_trees(pairs.individual_pairs(pairs.pair_sums(pairs.pair_rows(every, keys, types), keys), keys), keys, types)
    out = meta.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bootstraps).cast("long"))))
    return out.join(trees, keys, "left").select("scaffold", "k", "start", "end", "mid", "sites", "replicate", F.when(F.length("newick") > 0, F.col("newick")).alias("newick"))


def frequency_spectrum(calls: DataFrame, pops: list, outgroup=None, regions: DataFrame | None = None, dims: list[int] | None = None) -> DataFrame:
    """The joint spectrum of ``pops`` (or some of them), per named region if given."""
    t = spectra.target_counts(calls, pops, outgroup)
    if regions is not None:
        from locusframe.operators.intervals import points_in_intervals

        return spectra.sfs(points_in_intervals(t, regions), dims or list(range(len(pops))), ["wname"])
    return spectra.sfs(t, dims or list(range(len(pops))))


def filter_genotypes(
    calls: DataFrame, thin: int | None = None, samples: list | None = None, drop_samples: list | None = None, hwe_p: float | None = None, by_pop: bool = True,
    populations: dict | None = None, no_test: bool = False, **tests,
) -> DataFrame:
    """Calls of the sites that pass the tests, then thinned; samples are chosen before.

    ``tests`` are those of ``sites.filter_sites``, ``populations`` those of
    ``sites.population_filter``; sites out of Hardy-Weinberg proportions at ``hwe_p`` (in
    any population, or over all samples) go. ``no_test`` lets all sites pass.
    """
    calls = convert.select_samples(calls, samples, drop_samples)
    if no_test:
        s = calls.select("scaffold", "position").distinct()
    else:
        s = sites.filter_sites(calls, **tests).select("scaffold", "position")
        if populations:
            s = s.join(sites.population_filter(calls, **populations).select("scaffold", "position"), ["scaffold", "position"], "left_semi")
        if hwe_p is not None:
            out = sites.hwe_test(calls, *(["pop"] if by_pop else [])).where(F.col("p") <= hwe_p)
            s = s.join(out, ["scaffold", "position"], "left_anti")
    if thin:
        s = sites.thin_sites(s, thin)
    return calls.join(s, ["scaffold", "position"], "left_semi")


#: Kernels by name, for analyses chosen at run time; users may add their own.
REGISTRY = {
    "popgen_windows": popgen_windows, "abba_baba_windows": abba_baba_windows, "four_pop_windows": four_pop_windows,
    "distance_matrices": distance_matrices, "paint": paint, "frequency_spectrum": frequency_spectrum, "filter_genotypes": filter_genotypes,
}


def run_by_name(name: str, calls: DataFrame, **options) -> DataFrame:
    return REGISTRY[name](calls, **options)
