"""What keeps tasks from growing with the tables: the genotype fixture, painting, sequences, LD."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe import fixtures
from locusframe.functions import bases as B
from locusframe.operators import coding, convert, ld, pairs, sites, summary
from locusframe.plans import analyses
from tests.test_convert import SCHEMA, random_calls


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_painting_by_rank_sum_in_one_pass_per_window(spark):
    calls, rows = random_calls(spark, 4, 60, 6, 0.2)
    at = {}
    for _, p, i, pop, h, a in rows:
        if a is not None:
            at.setdefault(((p - 1) // 100, 2 * i + h, pop), {})[p] = a
    out = analyses.paint(calls, 100, p_threshold=0.3)
    assert "FlatMapGroupsInPandas" not in plan(out)
    want = {}
    for k, h, _ in at:
        near = {}
        for (w, b, pop), other in at.items():
            both = [at[k, h, _][p] != other[p] for p in at[k, h, _] if p in other]
            if w == k and both:
                near.setdefault(pop, []).append(sum(both) / len(both))
        best = min(near, key=lambda q: (round(np.mean(near[q]), 12), q))
        sure = all(summary.rank_sum_less(np.array(near[best]), np.array(v)) <= 0.3 for q, v in near.items() if q != best)
        want[k, h] = best if sure else -1
    assert {(r.k, r.h): r.painted for r in out.collect()} == want
    assert len(set(want.values())) > 1


def test_painting_by_delta_does_not_depend_on_the_order_of_sums(spark):
    # distances of h = 0 to population 1 are tenths that sum to exactly 0.1 more than those to population 0
    def painted(order):
        near, far = [0.1, 0.2, 0.3], [0.2, 0.3, 0.4]
        haps = [h for h in order if h]
        d = dict(zip(haps, near + far, strict=True))
        pop = {h: int(i >= 3) for i, h in enumerate(haps)} | {0: 2}
        rows = [("s", 0, 0, [(h, 10, round(10 * d[h])) for h in sorted(haps)])]
        r = spark.createDataFrame(rows, "scaffold string, k long, a long, pairs array<struct<b: long, called: long, diff: long>>")
        pops = spark.createDataFrame(list(pop.items()), "h long, pop long")
        got = summary.paint_delta(r, pops, ["scaffold", "k"], "scaffold string, k long", 0.1)
        return next(x.painted for x in got.collect() if x.h == 0)

    assert {painted(o) for o in ([0, 1, 2, 3, 4, 5, 6], [0, 3, 2, 1, 6, 5, 4], [0, 2, 3, 1, 4, 6, 5], [0, 6, 2, 4, 3, 5, 1])} == {0}


def test_fixture_is_dealt_out_by_sites(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "SITES_A_TASK", 20, raising=False)
    g = fixtures.geno_view(spark, sf)
    assert g.rdd.getNumPartitions() == 10
    assert g.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 50 * 60
    plain = spark.sql(fixtures.GENO_SQL, part=fixtures.table(spark, sf, "part"), nation=fixtures.table(spark, sf, "nation"))
    assert g.schema == plain.schema and g.exceptAll(plain).isEmpty() and plain.exceptAll(g).isEmpty()
    # the one exchange is that of the sites, before they have calls
    for df in (sites.filter_sites(g, max_het=0.4), sites.population_filter(g, min_pop_calls=4)):
        assert plan(df).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(df)


def test_site_filters_against_brute_force(spark):
    calls, rows = random_calls(spark, 8, 40, 5, 0.3)
    at = {}
    for _, p, i, pop, h, a in rows:
        at.setdefault(p, {}).setdefault((pop, i), []).append(a)
    got = {r.position: r for r in sites.filter_sites(calls, min_calls=0, min_alleles=0).collect()}
    pops = {r.position: r for r in sites.population_filter(calls).collect()}
    for p, g in at.items():
        found = [a for v in g.values() for a in v if a is not None]
        full = [v for v in g.values() if None not in v]
        assert (got[p].called, got[p].haps, got[p].n_samples) == (len(found), sum(map(len, g.values())), len(g))
        assert (got[p].full_calls, got[p].het_calls) == (len(full), sum(len(set(v)) > 1 for v in g.values()))
        each = [sum(None not in v for k, v in g.items() if k[0] == q) for q in {k[0] for k in g}]
        assert pops[p].min_calls == min(each) and pops[p].n_alleles == len(set(found))


def test_codons_are_read_in_one_pass(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("ACGTN", k=300_001))
    df = spark.createDataFrame([(text,), ("TA",), ("",), (None,), ("TAATAA",)], "s string")
    out = df.select(B.translate(F.col("s")).alias("t"), B.count_stops(F.col("s")).alias("n"), B.count_stops(F.col("s"), True).alias("all"))
    assert "substring(s#" not in plan(df.select(B.translate(F.col("s"))))
    code = B.genetic_code()
    aa = "".join(code.get(text[i : i + 3], "X") for i in range(0, 300_000, 3))
    assert [tuple(r) for r in out.collect()] == [(aa, aa[:-1].count("_"), aa.count("_")), ("", 0, 0), ("", 0, 0), ("", 0, 0), ("__", 1, 2)]


def test_regions_read_the_pieces_they_meet(spark):
    rng = random.Random(2)
    seqs = {n: "".join(rng.choices("ACGT", k=k)) for n, k in (("a", 1000), ("b", convert.PIECE), ("c", 1), ("d", 0))}
    regions = [(n, s, s + rng.randrange(-3, 600), rng.choice("+-")) for n in "abcde" for s in rng.sample(range(1, 1100), 40)] + [("a", None, 700, "+"), ("a", 300, None, "-"), ("b", None, None, "+")]
    q = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    r = spark.createDataFrame(regions, "chrom string, start long, end long, strand string")
    out = convert.subset_sequences(q, r, 2, 1)
    assert "substring(seq" not in plan(out)
    want = []
    for n, s, e, strand in regions:
        if n in seqs:
            t = seqs[n]
            whole = s is None and e is None and strand == "+"
            a, z = (1, len(t)) if whole else (max(1, (s or 1) - 2), min(len(t), (len(t) if e is None else e) + 1))
            x = t[a - 1 : max(a - 1, z)]
            want.append((n if whole else f"{n}:{a}-{z}:{strand}", x if strand == "+" else x[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_lines_are_read_across_sequences(spark):
    rng = random.Random(3)
    rows = [(s, n, "".join(rng.choices("ACGTN", k=k))) for s in ("x", "y") for n, k in (("q", 600), ("p", 600), ("r", 599), ("e", 0))]
    seqs = spark.createDataFrame(rows, "scaffold string, name string, seq string")
    read = lambda df: sorted((r.scaffold, r.position, [tuple(v) for v in r.samples]) for r in df.collect())
    for order in (None, ["r", "q"]):
        got = read(convert.sequences_to_lines(seqs, order))
        assert got == read(convert.sites_to_lines(convert.sequences_to_sites(seqs), order)) and len(got) == 1200
        names = order or ["p", "q", "r"]
        assert got[0][2] == [(n, next(t for s, m, t in rows if s == "x" and m == n)[0]) for n in names]


def test_long_windows_are_joined_by_stretches(spark):
    calls, rows = random_calls(spark, 9, 50, 3, 0.2)
    read = lambda df: sorted(map(tuple, df.select("sample", "hap", "first_site", "last_site", "seq").collect()))
    assert read(convert.window_sequences(calls, "scaffold", stretch=40)) == read(convert.window_sequences(calls, "scaffold"))
    assert convert.window_sequences(calls, "scaffold", stretch=40, min_sites=51).isEmpty()


def test_ld_of_blocks_against_brute_force(spark):
    calls, rows = random_calls(spark, 11, ld.BLOCK + 30, 4, 0.2)
    out = ld.ld_pairs(calls, [], 3000)
    assert "Join" not in plan(out)
    at = {}
    for _, p, i, _, h, a in rows:
        if a is not None:
            at.setdefault(p, {})[2 * i + h] = a
    want = {}
    for p, q in itertools.combinations(sorted(at), 2):
        z = [(at[p][h], at[q][h]) for h in at[p] if h in at[q]]
        x, y = [v[0] for v in z], [v[1] for v in z]
        if q - p <= 3000 and len(set(x)) == len(set(y)) == 2:
            top = lambda v: min(set(v), key=lambda b: (-v.count(b), b))
            pa, pb = x.count(top(x)) / len(z), y.count(top(y)) / len(z)
            d = z.count((top(x), top(y))) / len(z) - pa * pb
            want[p, q] = (len(z), d, d * d / (pa * (1 - pa) * pb * (1 - pb)))
    got = {(r.pos_a, r.pos_b): (r.n, r.d, r.r2) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_trees_draw_sites_as_one_row(spark):
    calls, _ = random_calls(spark, 12, 60, 4, 0.2)
    out = analyses.trees_by_window(calls, 200, bootstraps=1, seed=3)
    packed = pairs.site_calls(calls, ["scaffold"])
    assert packed.columns == ["scaffold", "position", "h", "allele"] and packed.count() == 60
    # calls meet no draw: sites and draws do
    assert "sample" not in next(x for x in plan(summary.resampled(packed, ["scaffold"], 1)).splitlines() if "Join" in x)
    drawn = summary.resampled(packed, ["scaffold"], 1, 3).groupBy("position").count()
    assert drawn.agg(F.max("count"), F.count("*")).first() == (1, 60)
    assert out.where("replicate = 1 and newick is not null").count() == out.where("replicate = 0 and newick is not null").count() > 0


def test_gene_alignments_join_a_row_per_site(spark):
    calls, rows = random_calls(spark, 13, 80, 3, 0.2)
    first = min(r[1] for r in rows)
    genes = spark.createDataFrame([("s", "m1", "+", [(first, first + 29)]), ("s", "m2", "-", [(first + 40, first + 61), (first + 5, first + 9)])], "scaffold string, mrna string, strand string, cds array<struct<start: long, end: long>>")
    out = coding.cds_alignments(genes, calls)
    assert "SortMergeJoin [scaffold" in plan(out) and "collect_list(struct(sample" in plan(out).split("SortMergeJoin [scaffold")[-1]
    at = {(r[1], r[2], r[4]): r[5] for r in rows}
    haps = {(r[2], r[4]) for r in rows}
    places = {"m1": list(range(first, first + 30)), "m2": [*range(first + 5, first + 10), *range(first + 40, first + 62)][::-1][:27]}
    letters = {"m1": "ACGT", "m2": "TGCA"}
    want = {}
    for m, p in places.items():
        for s, h in haps:
            if any((x, s, h) in at for x in p):
                want[m, s, h] = "".join("N" if at.get((x, s, h)) is None else letters[m][at[x, s, h]] for x in p)
    assert {(r.mrna, r["sample"], r.hap): r.sequence for r in out.collect()} == want
