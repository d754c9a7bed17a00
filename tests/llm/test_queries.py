"""The registered queries and the pipeline over whole small tables."""

import glob
import hashlib
import math
import os
import zlib

import corpus_pipeline
import duckdb
import pytest
from locusframe.llm import queries as q
from locusframe.llm import simhash

from tests.llm.test_operators import brute_bytes, brute_components, brute_contained, brute_lines, brute_print, water

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    rel = con.execute(q.ORACLES[name])
    names = [d[0] for d in rel.description]
    plain = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(names)
    assert sorted(got.columns) == order
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in rel.fetchall()), key=repr)


def test_op2(spark):
    t = texts(spark)
    prints = [brute_print(x) for _, x in t]
    comp = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {i: (f"{p:016x}", t[c][0]) for (i, _), p, c in zip(t, prints, comp, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op2_simhash_groups(spark, SF).collect()} == want


def test_op3(spark):
    t = texts(spark)
    gone = brute_lines([x for _, x in t], 20)
    want = {i: (len(g), hashlib.sha256("\n".join(s for k, s in enumerate(x.split("\n")) if k not in g).encode()).hexdigest()) for (i, x), g in zip(t, gone, strict=True)}
    assert {r.doc_id: (r.n_removed_lines, r.kept_sha256) for r in q.op3_line_dedup(spark, SF).collect()} == want


def test_op5(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = q.op5_quality_votes(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_op8(spark):
    t = texts(spark)
    want = {i: (n, cut, runs, hashlib.sha256(kept).hexdigest()) for (i, _), (n, cut, runs, kept) in zip(t, brute_bytes([x for _, x in t]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op8_substring_dedup(spark, SF).collect()} == want


def test_op9(spark):
    rows = q.op9_mix_sources(spark, SF).collect()
    size, taken, target, most = {}, {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = water(size)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6 and abs(taken[s] - want[s]) <= most[s] and rows for s in size)


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in before}
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality rules":
            led = {r.doc_id: r.kept for r in q.op10_quality_rules(spark, SF).collect()}
            assert set(after) == {d for d, k in led.items() if k}
        elif name == "line dedup":
            want = {}
            for (d, t), gone in zip(before, brute_lines([t for _, t in before], 20), strict=True):
                left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
                if left.split() or not gone:
                    want[d] = left
            assert after == want
        elif name == "simhash near-dedup":
            # the texts before and after lines were cut
            was = dict(texts(spark))
            sets = [[set(simhash.shingle_hashes(x, 5).tolist()) for x in {t, was[d]}] for d, t in before]
            comp = brute_components(sets, lambda a, b: any(len(x & y) / max(1, len(x | y)) >= 0.8 for x in a for y in b))
            assert set(after) == {before[c][0] for c in comp}
        else:
            bad = {before[d][0] for d, *_ in brute_contained([t for _, t in before], items)}
            assert set(after) == {d for d, _ in before} - bad


def test_stages_on_odd_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, None, None, 9), (1, good, None, None, 9), (None, good + " x", None, "s", None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    for data in (rows, []):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            d = spark.read.parquet(str(tmp_path / "documents.parquet"))
            assert stage(spark, d, str(tmp_path)).count() <= len(data)
        assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(data)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and rows.count() > 0
