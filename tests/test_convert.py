"""Conversions, windows by name, liftover and writers on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import convert, coding, diversity, intervals, merge, pairs, sites, spectra, summary, windows
from locusframe.plans import analyses
from locusframe.sinks import formats
from locusframe.sources import text

SCHEMA = "scaffold string, position long, sample long, pop long, hap long, allele long"


def random_calls(spark, seed=1, n_sites=40, n_samples=5, missing=0.1):
    r = random.Random(seed)
    rows = []
    for p in sorted(r.sample(range(1, 400), n_sites)):
        two = r.sample(range(4), 2)
        rows += [("s", p, i, i % 2, h, None if r.random() < missing else r.choice(two)) for i in range(n_samples) for h in (0, 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_predefined_windows_of_one_name(spark):
    s = spark.createDataFrame([("s", p) for p in (1, 10, 11, 12, 20)], "scaffold string, position long")
    w = spark.createDataFrame([("NA", "s", 1, 10), ("NA", "s", 11, 20), ("NA", "t", 1, 10), ("NA", "s", 11, 20)], "wname string, scaffold string, start long, end long")
    got = sorted((r.scaffold, r.start, r.sites, r.mid) for r in windows.predefined_windows(s, w).collect() if r.sites)
    assert got == [("s", 1, 2, 6), ("s", 11, 3, 14), ("s", 11, 3, 14)]
    assert windows.predefined_windows(s, w).count() == 4


def test_liftover_rows_of_one_id_and_strands(spark):
    t = spark.createDataFrame([("n", 101, 110, "a", 1, 10, "+"), ("n", 201, 210, "a", 21, 30, "-"), ("m", 1, 5, "b", 1, 5, "+"), ("m", 11, 15, "b", 1, 5, "+")], "new_scaf string, new_start long, new_end long, scaf string, start long, end long, strand string")
    rows = spark.createDataFrame([(1, "a", 2, 4, "+"), (1, "a", 22, 25, "+"), (1, "a", 22, 25, "-"), (None, "a", 5, 25, "+"), (2, "b", 2, 3, "+"), (2, "z", 2, 3, "+"), (2, "z", 2, 3, "+")], "id long, scaf string, start long, end long, strand string")
    got = sorted((r.id or 0, r.scaf, r.start, r.status, r.new_scaf or "", r.new_start or 0, r.new_end or 0, r.strand or "") for r in intervals.liftover(rows, t, 7).collect())
    assert got == [
        (0, "a", 5, "BROKEN", "", 0, 0, ""), (1, "a", 2, "OK", "n", 102, 104, "+"), (1, "a", 22, "OK", "n", 206, 209, "+"), (1, "a", 22, "OK", "n", 206, 209, "-"),
        (2, "b", 2, "BROKEN", "", 0, 0, ""), (2, "z", 2, "MISSING", "", 0, 0, ""), (2, "z", 2, "MISSING", "", 0, 0, ""),
    ]


def test_reduced_intervals_over_bins(spark):
    r = random.Random(3)
    iv = [(r.choice("ab"), s, s + r.choice((0, 3, 20, 300))) for s in (r.randrange(3000) for _ in range(300))]
    want = []
    for c in "ab":
        for s, e in sorted((s, e) for k, s, e in iv if k == c):
            if want and want[-1][0] == c and s <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
                want[-1][3] += 1
            else:
                want.append([c, s, e, 1])
    df = spark.createDataFrame(iv, "chrom string, start long, end long")
    for size in (7, 100, 10_000):
        assert sorted([x.chrom, x.start, x.end, x.n] for x in intervals.reduce_intervals(df, size).collect()) == sorted(want)
    assert intervals.reduce_intervals(df.limit(0)).count() == 0


def test_vcfs_merged(spark):
    call = lambda s, g: (s, {"GT": g, "DP": "9"})
    schema = "chrom string, pos long, ref string, alt array<string>, qual double, calls array<struct<sample: string, fields: map<string, string>>>"
    a = spark.createDataFrame([("c", 1, "A", ["C"], 9.0, [call("x", "0/1"), call("y", "1|1")]), ("c", 2, "G", [], 9.0, [call("x", "0/0"), call("y", "./.")]), ("c", 1, "T", ["C"], 9.0, [call("x", "0/0"), call("y", "0/0")])], schema)
    b = spark.createDataFrame([("c", 1, "A", ["C"], None, [call("z", "0/0")]), ("c", 3, "T", ["G"], None, [call("z", "0/1")])], schema)
    got = {r.position: (r.gt_0, r.gt_1) for r in convert.merge_vcfs([a, b], "union").collect()}
    assert got == {1: ("A/C\tC|C", "A/A"), 2: ("G/G\tN/N", "N/N"), 3: ("N/N", "T/G")}
    assert [r.position for r in convert.merge_vcfs([a, b]).collect()] == [1]


def test_site_table_and_sequences(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("#CHROM POS a b\ns 1 0.5 x\ns 2 nan 3\n")
    got = {(r.position, r.name): r.value for r in convert.site_table(text.read_geno(spark, str(p))).collect()}
    assert got[1, "a"] == 0.5 and got[1, "b"] is None and got[2, "b"] == 3.0
    s = spark.createDataFrame([("c0", "x", "ACG"), ("c0", "y", "TTN"), ("c1", "x", "G")], "scaffold string, name string, seq string")
    lines = {(r.scaffold, r.position): [(v["sample"], v["gt"]) for v in r.samples] for r in convert.sites_to_lines(convert.sequences_to_sites(s), ["y", "x"]).collect()}
    assert lines[("c0", 3)] == [("y", "N"), ("x", "G")] and lines[("c1", 1)] == [("x", "G")] and len(lines) == 4
    r = spark.createDataFrame([("q", None, None, "+"), ("q", 2, 3, "-"), ("q", 3, 99, "+"), ("z", 1, 2, "+")], "chrom string, start long, end long, strand string")
    q = spark.createDataFrame([("q", "AACGT")], "name string, seq string")
    assert sorted(tuple(x) for x in convert.subset_sequences(q, r).collect()) == [("q", "AACGT"), ("q:2-3:-", "GT"), ("q:3-5:+", "CGT")]


def test_writers_of_side_files(spark, tmp_path):
    head = formats.vcf_header(["a", "b"], [("c", 9)]).split("\n")
    assert head[1] == "##contig=<ID=c,length=9>" and head[-1].split("\t")[-2:] == ["a", "b"]
    s = spark.createDataFrame([(1,), (2,)], "sample long")
    assert [r.line for r in formats.eigenstrat_individuals(s).orderBy("ord").collect()] == ["1  U  NA", "2  U  NA"]
    assert [r.line for r in formats.plink_family(s).orderBy("ord").collect()] == ["0 1 0 0 0 0", "0 2 0 0 0 0"]
    m = spark.createDataFrame([(1, "0.0 0.5"), (2, "0.5 0.0")], "s1 long, cells string")
    assert formats.matrix_text(m, []).first().text == "0.0 0.5\n0.5 0.0"
    assert formats.matrix_text(m, [], "phylip").first().text == "2\n1  0.0 0.5\n2  0.5 0.0"
    nexus = formats.matrix_text(m, [], "nexus").first().text
    assert "ntax=2" in nexus and "[2] '2'    0.5 0.0\n;" in nexus
    p = spark.createDataFrame([("a", 3), ("a", 7), ("b", 2)], "scaffold string, position long")
    assert sorted((r.scaffold, r.cumulative) for r in formats.cumulative_positions(p).collect()) == [("a", 3), ("a", 7), ("b", 9)]
    f = spark.createDataFrame([(0, 1, 5)], "n_0 long, n_1 long, sites long")
    assert formats.spectrum_lines(f, [0, 1]).first().line == "0\t1\t5"
    formats.write_by(spark.createDataFrame([("x", 2, "two"), ("x", 1, "one"), ("y", 1, "z")], "w string, ord int, line string"), str(tmp_path / "by"), "w")
    assert "".join(q.read_text() for q in (tmp_path / "by" / "w=x").glob("part*")) == "one\ntwo\n"
    c = spark.createDataFrame([("s", 1, 0, 0, 0, 3), ("s", 1, 0, 0, 1, 1), ("s", 1, 1, 0, 0, 3), ("s", 1, 1, 0, 1, None)], SCHEMA)
    assert sorted((r["sample"], r.gt) for r in formats.ordered_letters(c).collect()) == [(0, "T/C"), (1, "T/N")]


def hwe_brute(het, hom1, hom2):
    """The exact test by listing all heterozygote counts."""
    from math import factorial as f

    n, a = het + hom1 + hom2, 2 * hom1 + het
    b = 2 * n - a
    weight = {}
    for k in range(min(a, b) % 2, min(a, b) + 1, 2):
        weight[k] = 2**k * f(n) / (f((a - k) // 2) * f(k) * f((b - k) // 2))
    total = sum(weight.values())
    return sum(w for w in weight.values() if w <= weight[het] * (1 + 1e-9)) / total


def test_hwe_by_brute_force():
    for het, a, b in itertools.product(range(9), repeat=3):
        if 0 < 2 * a + het and 0 < 2 * b + het:
            assert sites.hwe_p(het, a, b) == pytest.approx(hwe_brute(het, a, b), abs=1e-9)


def test_clusters_by_brute_force():
    r = random.Random(5)
    for _ in range(20):
        n = r.randint(1, 7)
        d = [[0.0 if i == j else None for j in range(n)] for i in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            d[i][j] = d[j][i] = r.choice([0.0, 0.1, 0.3])
        live, want = set(range(n)), []
        while live:
            near = {i: {j for j in live if d[i][j] <= 0.1} for i in live}
            best = max(sorted(live), key=lambda i: len(near[i]))
            if len(near[best]) <= 1:
                want += [1] * len(live)
                break
            want.append(len(near[best]))
            live -= near[best]
        import numpy as np

        assert diversity.greedy_clusters(np.array(d), 0.1) == want


def test_subsampled_spectrum_is_a_spectrum_of_subsamples(spark):
    c, rows = random_calls(spark, 4, 60, 6)
    got = spectra.sfs(spectra.subsample_counts(c, [0, 1], 4), [0, 1]).collect()
    called = {}
    for _, p, _, pop, _, a in rows:
        if a is not None:
            called.setdefault(p, {}).setdefault(pop, []).append(a)
    enough = [p for p, v in called.items() if all(len(v.get(k, [])) >= 4 for k in (0, 1))]
    assert sum(x.sites for x in got) <= len(enough) and all(0 <= x.n_0 <= 4 and 0 <= x.n_1 <= 4 for x in got)


def test_window_trees_join_the_nearest(spark):
    d = {(0, 1): 0.1, (0, 2): 0.5, (0, 3): 0.5, (1, 2): 0.5, (1, 3): 0.5, (2, 3): 0.1}
    rows = [("s", 0, a, b, x) for (a, b), x in d.items()]
    t = summary.window_trees(spark.createDataFrame(rows, "scaffold string, k long, s1 long, s2 long, dist double"), ["scaffold", "k"], "scaffold string, k long").first()
    tree = [v for v in t.asDict().values() if isinstance(v, str) and v.endswith(";")][0]
    assert "(0:0.05,1:0.05)" in tree or "(2:0.05,3:0.05)" in tree


def test_windows_of_limited_length_by_brute_force(spark):
    r = random.Random(8)
    p = sorted(r.sample(range(1, 2000), 150))
    s = spark.createDataFrame([("s", x) for x in p], "scaffold string, position long")
    got = [(x.start, x.end, x.sites) for x in windows.site_windows_max_distance(s, 6, 2, 60, 3).orderBy("i").collect()]
    for a, z, n in got:
        inside = [x for x in p if a <= x <= z]
        assert len(inside) == n and 3 <= n <= 6 and z - a <= 60
        # it could not have grown
        later = [x for x in p if x > z]
        assert n == 6 or not later or later[0] - a > 60


def test_streamed_pairs_equal_whole_windows(spark):
    c, rows = random_calls(spark, 9, 60, 4)
    want = {}
    for (_, p, i, _, h, a), (_, q, j, _, g, b) in itertools.product(rows, rows):
        if p == q and (i, h) < (j, g) and a is not None and b is not None:
            k = (p - 1) // 50, 2 * i + h, 2 * j + g
            n, d = want.get(k, (0, 0))
            want[k] = n + 1, d + (a != b)
    got = {(x.k, x.a, x.b): (x.called, x["diff"]) for x in pairs.window_pairs(c, 50).where("a < b").collect()}
    assert got == want
    assert pairs.window_pairs(c.limit(0), 50).count() == 0 and analyses.distance_matrices(c.limit(0)).count() == 0


def test_repeated_sites_and_genes(spark):
    rows = spark.createDataFrame([("s", 1, 5, "b"), ("s", 1, 2, "a"), ("s", 2, 1, "c")], "scaffold string, position long, o long, v string")
    assert sorted((r.position, r.v) for r in merge.dedup_sites(rows, "o").collect()) == [(1, "a"), (2, "c")]
    genes = spark.createDataFrame([("s", "m1", "+", [(1, 6)])], "scaffold string, mrna string, strand string, cds array<struct<start: long, end: long>>")
    assert [(r.codon, r.place) for r in coding.coding_positions(genes).orderBy("position").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_bootstrap_trees(spark, tmp_path):
    r = random.Random(12)
    rows = [("s", p, s, s % 2, h, r.choice([0, 0, 1, None])) for p in range(1, 301, 3) for s in range(4) for h in (0, 1)]
    rows += [("t", 5, s, s % 2, h, s // 2) for s in range(4) for h in (0, 1)]  # one site: a replicate is the data
    calls = spark.createDataFrame(rows, SCHEMA)
    drawn = summary.resampled(calls.withColumn("k", F.lit(0)), ["scaffold", "k"], 3, 1).collect()
    assert len(drawn) == 3 * len(rows)
    site = {}
    for x in rows:
        site.setdefault(x[:2], {})[x[2], x[4]] = x[5]
    got = {}
    for x in drawn:
        got.setdefault((x.scaffold, x.replicate, x.position), {})[x.sample, x.hap] = x.allele
    assert len(got) == 3 * len(site) and all(v in [w for k, w in site.items() if k[0] == x[0]] for x, v in got.items())
    assert len({tuple(sorted((p, str(v)) for (s, b, p), v in got.items() if b == i)) for i in (1, 2, 3)}) == 3
    t = analyses.trees_by_window(calls, 100, bootstraps=2, seed=1).collect()
    plain = {(x.scaffold, x.k): x.newick for x in summary.window_trees(pairs.individual_pairs(pairs.window_pairs(calls, 100), ["scaffold", "k"]), ["scaffold", "k"], "scaffold string, k long").collect()}
    assert len(t) == 3 * len(plain) and all(x.newick == plain[x.scaffold, x.k] for x in t if x.replicate == 0 or x.scaffold == "t")
    assert sorted(map(str, t)) == sorted(map(str, analyses.trees_by_window(calls.repartition(7), 100, bootstraps=2, seed=1).collect()))
    assert {x.newick is None for x in analyses.trees_by_window(calls, 100, min_snps=2, bootstraps=1).where("scaffold = 't'").collect()} == {True}
    least = min(sum(v is not None for (s, p), site_calls in site.items() if s == "s" and p <= 100 for k, v in site_calls.items() if k == key) for key in site["s", 1])
    first = lambda n: analyses.trees_by_window(calls, 100, min_per_ind=n).where("scaffold = 's' and k = 0").first().newick
    assert first(least) is not None and first(least + 1) is None
    assert analyses.trees_by_window(calls.limit(0), 100, bootstraps=1).count() == 0
    kept = analyses.trees_by_window(calls, 100, min_snps=2, bootstraps=1)
    formats.write_by(formats.tree_lines(kept), str(tmp_path / "trees"), "replicate")
    lines = [x.value for x in spark.read.text(str(tmp_path / "trees" / "replicate=1")).collect()]
    assert len(lines) == formats.tree_data_lines(kept).count() == 4 and lines[-1] == "NA"
