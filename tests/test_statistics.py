"""Hand-computed fixtures and brute force for the statistics."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from locusframe.operators import diversity, fourpop, ld, pairs, sites, spectra, summary, windows
from locusframe.plans import analyses
from pyspark.sql import functions as F

SCHEMA = "scaffold string, position long, sample long, pop long, hap long, allele long"
MF1 = {1: "A/A A/G G/G G/G", 4: "C/C C/C C/T T/T", 9: "T/T N/N T/T T/A", 12: "G/G G/G G/G G/G", 25: "A/C A/A G/A A/N"}


def calls(spark, table, pops=(0, 0, 1, 1), scaffold="s1"):
    rows = []
    for pos, line in table.items():
        for s, gt in enumerate(line.split()):
            for h, b in enumerate(gt.split("/")):
                rows.append((scaffold, pos, s, pops[s], h, None if b == "N" else "ACGT".index(b)))
    return spark.createDataFrame(rows, SCHEMA)


def near(a, b, tol=1e-6):
    return a == pytest.approx(b, abs=tol)


def test_pi_dxy_fst(spark):
    c = calls(spark, MF1)
    one = diversity.diversity(pairs.window_pairs(c, 100), analyses.haplotype_pops(c), ["scaffold", "k"]).collect()
    assert len(one) == 1
    r = one[0]
    assert near([r.pi_x, r.pi_y, r.dxy, r.fst], [0.2416667, 0.3, 0.471875, 0.2978395])
    w = {r.k: r for r in diversity.diversity(pairs.window_pairs(c, 10), analyses.haplotype_pops(c), ["scaffold", "k"]).collect()}
    assert near([w[0].pi_x, w[0].pi_y, w[0].dxy, w[0].fst], [0.25, 0.3333333, 0.6458333, 0.4096386])


def pair_join(calls, keys):
    """Pair counts for a < b as a self-join by site."""
    c = calls.where("allele is not null").select(*keys, "scaffold", "position", (F.col("sample") * 2 + F.col("hap")).alias("h"), "allele")
    on = list(dict.fromkeys([*keys, "scaffold", "position"]))
    p = c.withColumnsRenamed({"h": "a", "allele": "x"}).join(c.withColumnsRenamed({"h": "b", "allele": "y"}), on).where("a < b")
    return p.groupBy(*keys, "a", "b").agg(F.count("*").alias("called"), F.count_if(F.col("x") != F.col("y")).alias("diff"))


def test_matrix_kernel_equals_join_and_tiles(spark):
    r = random.Random(1)
    t = {p: " ".join("/".join(r.choice("ACGTN") for _ in range(2)) for _ in range(4)) for p in sorted(r.sample(range(1, 400), 60))}
    c = calls(spark, t)
    key = lambda x: (x.a, x.b, x.called, x.diff)
    assert sorted(map(key, pairs.pair_counts(c, [], "").where("a < b").collect())) == sorted(map(key, pair_join(c, []).collect()))
    for size, step in ((50, None), (60, 20), (20, 50)):
        got = {(x.k, x.a, x.b): (x.called, x.diff) for x in pairs.window_pairs(c, size, step).where("a < b").collect()}
        placed = windows.in_coordinate_windows(c, size, step)
        assert got == {(x.k, x.a, x.b): (x.called, x.diff) for x in pair_join(placed, ["k"]).collect()}


def test_theta_and_heterozygosity(spark):
    c = calls(spark, MF1)
    t = {r["pop"]: r for r in diversity.theta_stats(c, ["scaffold"]).collect()}
    for p in (0, 1):
        assert (t[p].l, t[p].s) == (3, 1) and near([t[p].theta_pi, t[p].theta_w, t[p].taj_d], [0.5, 0.5454545, -0.6123724])
    h = {r["sample"]: (r.sites, r.het) for r in pairs.heterozygosity(c, ["scaffold"]).collect()}
    assert h == {0: (5, pytest.approx(0.2)), 1: (4, 0.25), 2: (5, pytest.approx(0.4)), 3: (4, 0.25)}
    full = {r.position: r.full_calls for r in sites.call_metrics(c).collect()}
    assert [full[p] for p in sorted(full)] == [4, 4, 3, 4, 3]


def test_coordinate_windows(spark):
    c = calls(spark, MF1)
    s = c.select("scaffold", "position").distinct()
    w = windows.window_summary(windows.coordinate_windows(s, 10), windows.in_coordinate_windows(s, 10), ["scaffold", "k"]).orderBy("k").collect()
    assert [(r.start, r.end, r.sites, r.mid) for r in w] == [(1, 10, 3, 5), (11, 20, 1, 12), (21, 30, 1, 25)]
    one = spark.createDataFrame([("s", 150)], "scaffold string, position long")
    assert [r.start for r in windows.coordinate_windows(one, 100, 20).orderBy("k").collect()] == [1, 21, 41, 61]
    gap = spark.createDataFrame([("s", 5), ("s", 50)], "scaffold string, position long")
    w = windows.window_summary(windows.coordinate_windows(gap, 10, 100), windows.in_coordinate_windows(gap, 10, 100), ["scaffold", "k"])
    assert sorted((r.start, r.end, r.sites) for r in w.collect()) == [(1, 10, 1), (101, 110, 0)]


def test_site_windows_and_thinning(spark):
    s = spark.createDataFrame([("s", 10 * i + 1) for i in range(7)], "scaffold string, position long")
    w = windows.site_windows(s, 3, 1, 2).orderBy("i").collect()
    assert [(r.start, r.end, r.sites) for r in w] == [(1, 21, 3), (21, 41, 3), (41, 61, 3)]
    t = spark.createDataFrame([("s", p) for p in (1, 5, 12, 14, 30)], "scaffold string, position long")
    assert sorted(r.position for r in sites.thin_sites(t, 10).collect()) == [12, 30]
    assert windows.max_distance_windows([1, 2, 3, 50, 51, 52, 53], 3, 1, 10, 2) == [(0, 2), (3, 5), (5, 6)]
    r = windows.ranked(spark.createDataFrame([("s", p) for p in range(0, 5000, 7)], "scaffold string, position long"), 100)
    assert all(x.position == 7 * x.rn for x in r.collect())


def four(spark, freqs):
    f = spark.createDataFrame([("s", i, *p) for i, p in enumerate(freqs)], "scaffold string, position long, p1 double, p2 double, p3 double, p4 double")
    return f


def test_four_population_statistics(spark):
    f = four(spark, [(0.0, 0.5, 1.0, 0.0), (0.25, 0.75, 0.5, 0.0), (0.5, 0.0, 0.5, 0.0)])
    r = fourpop.four_pop(f, ["scaffold"]).first()
    assert near([r.ABBA, r.BABA, r.D, r.fd, r.fdM, r.fhom, r.fh, r.fdh], [0.78125, 0.28125, 0.4705882, 0.3636364, 0.3076923, 0.4444444, 0.3333333, 0.3636364])
    assert math.copysign(1, r.D) == math.copysign(1, r.D_new) and -1 <= r.fh <= 1
    t = fourpop.terms()
    b = f.select("scaffold", t["n_f4"].alias("x"), t["d_d"].alias("y"))
    j = summary.jackknife_ratio(b, ["scaffold"], "x", "y").first()
    assert near([j["mean"], j["var"], j.sd, j.se], [0.5741579, 0.8739864, 0.9348724, 0.5397488])
    g = summary.jackknife(b.toPandas(), lambda d: d.x.sum() / d.y.sum())
    assert near([g["mean"], g["se"]], [0.5741579, 0.5397488])


def test_hardy_weinberg(spark):
    assert near(sites.hwe_p(1, 5, 4), 0.0150036) and near(sites.hwe_p(5, 3, 2), 1.0) and sites.hwe_p(0, 0, 0) is None
    c = calls(spark, {1: " ".join(["A/A"] * 5 + ["A/C"] + ["C/C"] * 4)}, pops=(0,) * 10)
    r = sites.hwe_test(c).first()
    assert (r.het, r.hom1, r.hom2) == (1, 5, 4) and near(r.p, 0.0150036)


def test_ld(spark):
    a, b = [0, 0, 1, 1, 0, 1], [0, 0, 1, 0, 0, 1]
    rows = [("s", p, i // 2, 0, i % 2, x) for p, v in ((1, a), (2, b), (3, [None, 0, 0, 0, 0, 0])) for i, x in enumerate(v)]
    r = ld.ld_pairs(spark.createDataFrame(rows, SCHEMA), []).collect()
    assert len(r) == 1 and near([r[0].d, r[0].d_prime, r[0].r2], [0.1666667, 1.0, 0.5])
    # two samples: the first two sites have two hets each, the third one
    m = np.array([[0, 1, 1, 0], [2, 3, 3, 2], [0, 0, 1, 0], [1, 1, 1, 1]])
    got = ld.phase_for_ld(m, [np.array([0, 1]), np.array([2, 3])])
    assert got.tolist() == [[0, 1, 0, 1], [2, 3, 2, 3], [0, 0, 0, 1], [1, 1, 1, 1]]
    r = random.Random(2)
    for _ in range(20):  # genotypes stay, homozygotes and sites without heterozygotes too
        m = np.array([[r.choice((-1, 0, 2)) for _ in range(8)] for _ in range(6)])
        got = ld.phase_for_ld(m, [np.arange(2 * i, 2 * i + 2) for i in range(4)])
        assert all(sorted(got[s, 2 * i : 2 * i + 2]) == sorted(m[s, 2 * i : 2 * i + 2]) for s in range(6) for i in range(4))
    rows = [("s", p, i // 2, 0, i % 2, x) for p, v in ((1, [0, 1, 1, 0]), (2, [2, 3, 3, None])) for i, x in enumerate(v)]
    out = ld.max_ld_phase(spark.createDataFrame(rows, SCHEMA), ["scaffold"], "scaffold string").orderBy("position", "sample", "hap").collect()
    assert [x.allele for x in out] == [0, 1, 0, 1, 2, 3, None, 3]


def test_haplotype_homozygosity(spark):
    assert near(list(diversity.homozygosity([3, 2, 1])), [14 / 36, 26 / 36, 5 / 36])
    t = {p: " ".join(x) for p, x in ((1, ("A/A", "A/C", "C/C")), (2, ("A/A", "A/A", "A/C")))}
    c = calls(spark, t, pops=(0, 0, 0))
    one = diversity.exact_haplotypes(c, ["scaffold"]).first()
    p = pairs.pair_counts(c, ["scaffold"], "scaffold string")
    two = diversity.haplotype_stats(p, analyses.haplotype_pops(c), ["scaffold"], "scaffold string").first()
    assert near([one.h1, one.h12, one.h2], [14 / 36, 26 / 36, 5 / 36]) and near([two.h1, two.h12, two.h2], [one.h1, one.h12, one.h2])
    assert diversity.greedy_clusters(np.array([[0, 1, 9], [1, 0, 1], [9, 1, 0]]), 1) == [3]


@pytest.mark.parametrize(("counts", "want"), [((3, 1, 0, 0), 1), ((4, 0, 0, 0), 0), ((2, 2, 0, 0), 2), ((2, 1, 1, 0), None)])
def test_spectrum_counts(spark, counts, want):
    gt = "".join(b * n for b, n in zip("ACGT", counts, strict=True))
    c = calls(spark, {1: f"{gt[0]}/{gt[1]} {gt[2]}/{gt[3]}"}, pops=(0, 0))
    r = spectra.target_counts(c, [0]).collect()
    assert [x.n_0 for x in r] == ([] if want is None else [want])


def test_spectrum_sums_and_subsample(spark):
    r = random.Random(3)
    c = calls(spark, {p: " ".join("/".join(r.choice("AC") for _ in range(2)) for _ in range(4)) for p in range(1, 80)})
    t = spectra.target_counts(c, [0, 1])
    assert spectra.sfs(t, [0, 1]).agg(F.sum("sites")).first()[0] == t.count() == 79
    s = spectra.subsample_counts(c, [0, 1], 3).collect()
    assert len(s) == 79 and all(0 <= x.n_0 <= 3 and 0 <= x.n_1 <= 3 for x in s)
    again = spectra.subsample_counts(c.repartition(5), [0, 1], 3).collect()
    assert sorted(map(tuple, s)) == sorted(map(tuple, again))


def test_patterns_and_frequencies(spark):
    c = calls(spark, {1: "A/A C/A", 2: "C/C C/T", 3: "A/N A/A"}, pops=(0, 1))
    assert {r.pattern: r.sites for r in spectra.genotype_patterns(c).collect()} == {"00 01": 2}
    f = {(r.position, r["pop"]): r.value for r in spectra.frequency_table(c, "minor").collect()}
    assert f[(1, 1)] == 0.5 and f[(3, 0)] is None
    assert {r.value for r in spectra.frequency_table(c).where("position = 2 and pop = 1").collect()} == {"0,1,0,1"}


def test_window_stats_and_rank_sum(spark):
    v = [1.0, 2.0, 4.0, float("nan"), 9.0]
    r = summary.window_stats(spark.createDataFrame([(1, x) for x in v], "k long, v double"), ["k"], "v").first()
    a = np.array([1, 2, 4, 9.0])
    assert near([r["mean"], r["median"], r.sd, r["sum"], r.q5, r.q95], [a.mean(), np.median(a), a.std(), 16, np.percentile(a, 5), np.percentile(a, 95)])
    assert near(summary.rank_sum_less(np.array([1.0, 2, 3]), np.array([4.0, 5, 6])), 0.5 * math.erfc(1.9639610 / math.sqrt(2)))


def test_painting(spark):
    c = calls(spark, {p: "A/A A/A C/C C/C" for p in range(1, 30)})
    d = {r.h: r.painted for r in analyses.paint(c, 100, delta=0.5).collect()}
    assert d == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    same = calls(spark, {p: "A/A A/A A/A A/A" for p in range(1, 9)})
    assert {r.painted for r in analyses.paint(same, 100).collect()} == {-1}


def test_neighbour_joining():
    d = np.array([[0, 5, 9, 9], [5, 0, 10, 10], [9, 10, 0, 8], [9, 10, 8, 0.0]])
    t = summary.neighbour_joining(list("abcd"), d)
    assert t.count("(") == 3 and t.endswith(";") and ("(a:2,b:3)" in t or "(c:4,d:4)" in t)
    assert summary.neighbour_joining(["x"], np.zeros((1, 1))) == "x;"


def test_popgen_windows(spark):
    c = calls(spark, MF1)
    r = analyses.popgen_windows(c, 10, analyses=("popFreq", "popDist", "indHet", "indPairDist", "hapStats"), failed=True).orderBy("start").collect()
    assert len(r) == 3 and near(r[0].Fst_0_1, 0.4096386) and {"l_0", "TajD_1", "dxy_0_1", "H12_0", "het_3", "d_0_3"} <= set(r[0].asDict())
    few = analyses.popgen_windows(c, 10, min_sites=2).collect()
    assert [x.start for x in few] == [1]
    q = analyses.filter_genotypes(c, min_calls=4)
    assert sorted({x.position for x in q.collect()}) == [1, 4, 12]
    assert analyses.run_by_name("abba_baba_windows", calls(spark, MF1, (0, 1, 2, 3)), pops=(0, 1, 2, 3), size=100).count() == 1


def test_pairs_of_populations_are_symmetric(spark):
    c = calls(spark, MF1)
    swapped = c.withColumn("pop", 1 - F.col("pop"))
    a, b = (diversity.diversity(pairs.pair_counts(x, [], ""), analyses.haplotype_pops(x), []).first() for x in (c, swapped))
    assert near(a.dxy, b.dxy) and near(a.fst, b.fst) and near(a.pi_x, b.pi_y)


def test_pair_distances_brute(spark):
    hap = np.array([[0, 1, -1, 2], [0, 0, 3, 2], [-1, 1, 3, 1]])
    rows = [("s", j + 1, i, 0, 0, None if x < 0 else int(x)) for i, v in enumerate(hap) for j, x in enumerate(v)]
    got = {(r.a // 2, r.b // 2): (r.called, r.diff) for r in pairs.pair_counts(spark.createDataFrame(rows, SCHEMA), [], "").where("a < b").collect()}
    for i, j in combinations(range(3), 2):
        m = (hap[i] >= 0) & (hap[j] >= 0)
        assert got[(i, j)] == (m.sum(), (hap[i] != hap[j])[m].sum())
