"""Options of distances, spectra, filters and VCF reading on small cases; region reads."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.functions import bases as B
from locusframe.operators import pairs, spectra
from locusframe.plans import analyses
from locusframe.sources import layout, text
from tests.test_convert import SCHEMA, random_calls


def test_distances_with_same_and_gates(spark):
    calls, rows = random_calls(spark, 3, 30, 4, 0.3)
    at = defaultdict(dict)
    for _, p, i, _, h, a in rows:
        if a is not None:
            at[2 * i + h][p] = a
    both = {(x, y): [at[x][p] != at[y][p] for p in at[x] if p in at[y]] for x in range(8) for y in range(8)}
    low = 14
    got = {(r.s1, r.s2): r.dist for r in pairs.individual_pairs(pairs.pair_counts(calls, [], ""), [], True, low).collect()}
    assert len(got) == 10
    for i, j in itertools.combinations_with_replacement(range(4), 2):
        d = [sum(v) / len(v) for x in (2 * i, 2 * i + 1) for y in (2 * j, 2 * j + 1) if len(v := both[x, y]) >= low]
        assert (got[i, j] is None) if not d else got[i, j] == pytest.approx(sum(d) / len(d))
    least = min(len(v) for v in at.values())
    assert all(r.dist is not None for r in analyses.distance_matrices(calls, min_per_ind=least).collect())
    assert all(r.dist is None for r in analyses.distance_matrices(calls, min_per_ind=least + 1).collect())
    windows = analyses.distance_matrices(calls, 200, min_per_ind=31)
    assert windows.count() and all(r.dist is None for r in windows.collect())


def test_individuals_drawn_for_spectra(spark):
    full, _ = random_calls(spark, 5, 20, 6, 0.0)
    key = lambda r: (r.position, r.n_0, r.n_1)
    assert sorted(map(key, spectra.subsample_individuals(full, [0, 1], 3).collect())) == sorted(map(key, spectra.target_counts(full, [0, 1]).collect()))
    some, rows = random_calls(spark, 6, 40, 8, 0.2)
    called = defaultdict(lambda: defaultdict(dict))
    for _, p, i, pop, h, a in rows:
        if a is not None:
            called[p][pop].setdefault(i, []).append(a)
    got = {r.position: (r.n_0, r.n_1) for r in spectra.subsample_individuals(some, [0, 1], 2).collect()}
    enough = {p for p, v in called.items() if all(len(v[q]) >= 2 for q in (0, 1))}
    assert got and set(got) <= enough
    for p, found in got.items():  # counts of one allele in some two samples of each population
        sums = [{tuple(sum(a == b for i in pair for a in called[p][q][i]) for b in range(4)) for pair in itertools.combinations(called[p][q], 2)} for q in (0, 1)]
        assert any(all(n in {s[b] for s in sums[q]} for q, n in enumerate(found)) for b in range(4))
    assert spectra.subsample_individuals(some, [0, 1], 5).count() == 0


def test_frequencies_of_individuals(spark):
    c = spark.createDataFrame([("s", 1, 0, 0, 0, 1), ("s", 1, 0, 0, 1, 2), ("s", 1, 1, 0, 0, 2), ("s", 1, 1, 0, 1, 2), ("s", 2, 0, 0, 0, 3), ("s", 2, 1, 0, 0, None)], SCHEMA)
    rows = lambda **o: sorted((r.position, r.sample, r.value) for r in spectra.frequency_table(c, "minor", by="sample", **o).collect())
    assert rows(keep_empty=False) == [(1, 0, 0.5), (1, 1, 0.0)]
    assert len(rows()) == 4
    none = spectra.frequency_table(c.where("sample = 1"), "minor", by="sample", as_counts=True, keep_empty=False)
    assert none.count() == 0


def test_filter_genotypes_by_hwe_and_samples(spark):
    rows = [("s", 1, i, 0, h, int(i >= 5)) for i in range(10) for h in (0, 1)] + [("s", 9, i, 0, h, h) for i in range(1) for h in (0, 1)] + [("s", 9, i, 0, h, 0) for i in range(1, 10) for h in (0, 1)]
    c = spark.createDataFrame(rows, SCHEMA)
    at = lambda **o: sorted({r.position for r in analyses.filter_genotypes(c, **o).collect()})
    assert at() == [1, 9] and at(hwe_p=0.01) == [9] and at(hwe_p=0.01, by_pop=False) == [9]
    assert at(hwe_p=0.01, no_test=True) == [1, 9]
    assert at(drop_samples=list(range(5)), min_alleles=2) == [] and at(populations={"min_pop_calls": 11}) == []
    assert {r["sample"] for r in analyses.filter_genotypes(c, samples=[0, 7]).collect()} == {0, 7}


def test_ploidy_mismatch(spark, tmp_path):
    lines = ["##contig=<ID=c>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb", "c\t1\t.\tA\tC\t9\t.\t.\tGT\t0/1\t1", "c\t2\t.\tA\tC\t9\t.\t.\tGT\t1|1\t0/0"]
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    v = text.read_vcf(spark, str(tmp_path / "v.vcf"))
    got = sorted((r.position, r["sample"], r.gt) for r in text.vcf_calls(v, ploidy=2, mismatch="missing").collect())
    assert got == [(1, "a", "A/C"), (1, "b", "N/N"), (2, "a", "C|C"), (2, "b", "A/A")]
    assert text.vcf_calls(v).count() == 4
    with pytest.raises(Exception, match="is not of ploidy 2"):
        text.vcf_calls(v, ploidy=2).collect()


def test_two_sequences(spark):
    x = spark.createDataFrame([(["AT", "C|G", "T", None, "A/A"], ["R", "A", "N", "Y"])], "gts array<string>, codes array<string>")
    r = x.select(B.two_sequences(F.col("gts")).alias("a"), B.two_sequences(F.col("codes"), True).alias("b"), B.homozygous_letters(F.col("codes")).alias("h")).first()
    assert r.a == ["ACNNA", "TGNNA"] and r.b == ["AANC", "GANT"] and r.h == ["N", "A", "N", "N"]


def test_region_reads_touch_what_they_need(spark, tmp_path):
    rows = [(s, p, p % 7) for s in ("01", "1", "x") for p in range(1, 301)]
    path = str(tmp_path / "t")
    layout.write_sorted(spark.createDataFrame(rows, "scaffold string, position long, v long"), path)
    got = layout.read_regions(spark, path, [("01", 10, 12), ("01", 12, 14), ("x", 299, None), ("none", None, None)])
    assert sorted((r.scaffold, r.position) for r in got.collect()) == [("01", p) for p in range(10, 15)] + [("x", 299), ("x", 300)]
    assert {r.scaffold for r in layout.read_regions(spark, path, [("1", None, 5)]).collect()} == {"1"}
    plan = layout.read_regions(spark, path, [("x", 5, 9)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(position,5)" in plan
    assert layout.read_regions(spark, path, []).count() == 0
