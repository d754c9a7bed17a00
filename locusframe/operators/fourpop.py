"""Four-population (ABBA-BABA) statistics as ratios of sums over sites.

Focal-allele frequencies p1..p4 come from one aggregation by site and population; each
statistic is a pair of column expressions that are summed per window and divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.sites import COUNTS, SITE, n_alleles, ranked_alleles


def frequencies(calls: DataFrame, pops: tuple, min_data: float = 0.0, polarize: bool = True, fixed: bool = False) -> DataFrame:
    """scaffold, position, p1..p4 of the usable sites.

    Usable: two alleles over the four populations, and enough called in each. Polarised,
    the focal allele is the one P4 lacks; ``fixed`` asks that P1..P3 be 0 or 1; else it
    is the second most frequent over all four, the lower base on ties.
    """
    number = F.coalesce(*[F.when(F.col("pop") == F.lit(p), i + 1) for i, p in enumerate(pops)])
    counts = []
    for i in range(1, 5):
        here = F.col("_i") == i
        counts += [F.count_if(here & (F.col("allele") == b)).alias(f"p{i}{c}") for b, c in enumerate(COUNTS)]
        counts += [F.count_if(here & F.col("allele").isNotNull()).alias(f"called{i}"), F.count_if(here).alias(f"haps{i}")]
    s = calls.withColumn("_i", number).where("_i is not null").groupBy(*SITE).agg(*counts)
    s = s.withColumns({c: F.col(f"p1{c}") + F.col(f"p2{c}") + F.col(f"p3{c}") + F.col(f"p4{c}") for c in COUNTS})
    s = s.where(n_alleles() == 2)
    for i in range(1, 5):
        s = s.where((F.col(f"called{i}") > 0) & (F.col(f"called{i}") >= min_data * F.col(f"haps{i}")))
    if polarize or fixed:
        missing = F.filter(F.array(*[F.when((F.col(c) > 0) & (F.col(f"p4{c}") == 0), F.lit(b)) for b, c in enumerate(COUNTS)]), lambda x: x.isNotNull())
        s = s.withColumn("_focal", F.get(missing, F.lit(0))).where("_focal is not null")
    else:
        # equal counts: the lower base is the second
        r = ranked_alleles()
        tie = F.get(r, F.lit(0))["neg"] == F.get(r, F.lit(1))["neg"]
        s = s.withColumn("_focal", F.when(tie, F.least(F.get(r, F.lit(0))["base"], F.get(r, F.lit(1))["base"])).otherwise(F.get(r, F.lit(1))["base"]).cast("int"))
    s = s.select(*SITE, *[(F.get(F.array(*[f"p{i}{c}" for c in COUNTS]), F.col("_focal")) / F.col(f"called{i}")).alias(f"p{i}") for i in range(1, 5)])
    return s.where("p1 in (0, 1) and p2 in (0, 1) and p3 in (0, 1)") if fixed else s


def f4(a, b, c, d) -> Column:
    return (1 - a) * b * c * (1 - d) - a * (1 - b) * c * (1 - d)


def f4c(a, b, c, d) -> Column:
    """f4 of an allele and of its complement."""
    return f4(a, b, c, d) + f4(1 - a, 1 - b, 1 - c, 1 - d)


def terms() -> dict[str, Column]:
    """Per site the numerators and denominators of all statistics."""
    p1, p2, p3, p4 = (F.col(f"p{i}") for i in range(1, 5))
    abba, baba = (1 - p1) * p2 * p3 * (1 - p4), p1 * (1 - p2) * p3 * (1 - p4)
    pd = F.greatest(p2, p3)
    donor = lambda f: f(p1, pd, pd, p4)
    swap = F.when(p1 > p2, True).otherwise(False)
    m1 = F.when(swap & (p3 > p1), p3).otherwise(p1)
    m2 = F.when(~swap & (p3 > p2), p3).otherwise(p2)
    m3 = F.when(swap, F.when(p3 > p1, -p3).otherwise(-p1)).otherwise(F.when(p3 > p2, p3).otherwise(p2))
    hull = F.greatest(f4c(p1, p3, p3, p4), f4c(p4, p2, p3, p4), f4c(p3, p2, p3, p4), f4c(p1, p4, p3, p4))
    hull2 = F.greatest(hull, f4c(p1, p2, p2, p4), f4c(p1, p2, p3, p1), f4c(p1, p2, p1, p4), f4c(p1, p2, p3, p2))
    widest = F.greatest(F.abs(p1 - p2), F.abs(p3 - p4))
    return {
        "abba": abba, "baba": baba, "abaa": (1 - p1) * p2 * (1 - p3) * (1 - p4), "baaa": p1 * (1 - p2) * (1 - p3) * (1 - p4),
        "abaa_babb": (1 - p1) * p2 * (1 - p3) * (1 - p4) + p1 * (1 - p2) * p3 * p4, "baaa_abbb": p1 * (1 - p2) * (1 - p3) * (1 - p4) + (1 - p1) * p2 * p3 * p4,
        "abba_baab": abba + p1 * (1 - p2) * (1 - p3) * p4, "baba_abab": baba + (1 - p1) * p2 * (1 - p3) * p4,
        "n_f4": f4(p1, p2, p3, p4), "n_f4c": f4c(p1, p2, p3, p4), "d_d": abba + baba,
        "d_new": abba + baba + p1 * (1 - p2) * (1 - p3) * p4 + (1 - p1) * p2 * (1 - p3) * p4,
        "d_fhom": f4(p1, p3, p3, p4), "d_fhomc": f4c(p1, p3, p3, p4), "d_fd": donor(f4), "d_fdc": donor(f4c),
        "d_fdm": f4(m1, m2, m3, p4), "d_fdmc": f4c(m1, m2, m3, p4), "d_fdh": hull, "d_fdh2": hull2, "d_fh": widest * widest,
    }


#: statistic: (numerator, denominator)
RATIOS = {
    "D": ("n_f4", "d_d"), "D_new": ("n_f4c", "d_new"), "fd": ("n_f4", "d_fd"), "fd_c": ("n_f4c", "d_fdc"), "fdM": ("n_f4", "d_fdm"), "fdM_c": ("n_f4c", "d_fdmc"),
    "fhom": ("n_f4", "d_fhom"), "fhom_c": ("n_f4c", "d_fhomc"), "fdh": ("n_f4c", "d_fdh"), "fdh2": ("n_f4c", "d_fdh2"), "fh": ("n_f4c", "d_fh"),
}
ABBA_BABA = ("D", "fd", "fdM")
#: Patterns counted together with those of exchanged alleles.
PAIRED = ("abaa_babb", "baaa_abbb", "abba_baab", "baba_abab")


def four_pop(freqs: DataFrame, keys: list[str], stats=tuple(RATIOS), sums=("abba", "baba", "abaa", "baaa"), min_sites: int = 1) -> DataFrame:
    """Statistics per window; ``freqs`` carries the window's keys. Zero denominators: null."""
    t = terms()
    need = dict.fromkeys([*sums, *(x for s in stats for x in RATIOS[s])])
    s = freqs.groupBy(*keys).agg(F.count("*").alias("sites_used"), *[F.sum(t[n]).alias(n) for n in need])
    good = F.col("sites_used") >= min_sites
    ratio = [F.when(good, F.try_divide(F.col(RATIOS[x][0]), F.col(RATIOS[x][1]))).alias(x) for x in stats]
    return s.select(*keys, "sites_used", *[F.when(good, F.col(x)).alias(x.upper()) for x in sums], *ratio)
