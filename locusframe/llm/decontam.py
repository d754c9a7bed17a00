"""Benchmark decontamination by size-partitioned MinHash containment search.

The queries are short items, the indexed sets long documents, and what counts is the
share of an item's word shingles that a document contains. A MinHash sketch of the
*item* decides: by seeded hash its ``m`` least shingles. Items are partitioned by
the power of two of their shingle count, and each partition takes the ``m`` of its
largest size: one more than the shingles an item may lack. So a document that
contains enough of the item contains at least one shingle of the sketch, however
long the document is, and the search loses nothing. Candidates are verified by exact
shingle containment. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_up_to, checkpoint, unused

#: Largest tables, in rows, that are broadcast; beyond that Spark shuffles both sides.
MAX_BROADCAST_SHINGLES = 1_000_000
MAX_BROADCAST_DOCS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, width: int, make) -> Column:
    return F.when(
        F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: make([F.get(words, i + k) for k in range(width)]))
    ).otherwise(F.array().cast("array<bigint>" if make is _name else "array<string>"))


def _name(ws) -> Column:
    return F.xxhash64(*ws)


def _text(ws) -> Column:
    return F.concat_ws(" ", *ws)


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, w, shingle, h, n): distinct shingles; an item of fewer words has one."""
    i = items.select("item_id", words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    i = i.select("item_id", "ws", F.least(F.lit(width), F.size("ws")).alias("w"))
    parts = [
        i.where(F.col("w") == k).select("item_id", "w", F.explode(F.arrays_zip(_shingles(F.col("ws"), k, _text).alias("shingle"), _shingles(F.col("ws"), k, _name).alias("h"))).alias("x"))
        for k in range(1, width + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("item_id", "w", "x.shingle", "x.h").distinct()
    return out.join(out.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, w, h): the least shingles of each item, as many as its size class needs."""
    # an item may lack n - ceil(t n) shingles; the largest n of a class is 2^(c+1) - 1
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    m = (top - F.ceil(top * threshold - 1e-9) + 1).cast("int")
    per = shingles.groupBy("item_id", "w", "n").agg(F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(7), "h").alias("r"), F.col("h").alias("h")))).alias("s"))
    return per.select("item_id", "w", F.explode(F.slice("s", F.lit(1), m)).alias("x")).select("item_id", "w", "x.h")


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of a document and an item it contains: keys, item_id, n_item, n_shared, containment.

    A pair qualifies if the document has at least ``threshold`` of the item's distinct
    shingles. Null and empty texts have no words and match nothing. Repeated document
    rows are judged together by their keys and text, so a pair comes once per distinct
    text under a key; items with equal texts each give their own pairs. Null keys are
    kept. Empty tables give no pairs. Only the named columns are read.
    """
    shingles = checkpoint(item_shingles(items, width))
    widths = [r[0] for r in shingles.select("w").distinct().collect()]  # at most ``width`` numbers
    sketch = checkpoint(sketches(shingles, threshold))
    d = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("text").alias("_text"))
    ks = [f"_k{i}" for i in range(len(keys))]
    d = d.withColumn("_t", F.xxhash64("_text"))
    hits = None
    for w in widths:
        s = broadcast_up_to(sketch.where(F.col("w") == w).select("item_id", "h"), MAX_BROADCAST_SHINGLES)
        x = d.select(*ks, "_t", words_of(F.col("_text")).alias("ws")).select(*ks, "_t", F.explode(_shingles(F.col("ws"), w, _name)).alias("h"))
        x = x.join(s, "h").select(*ks, "_t", "item_id")
        hits = x if hits is None else hits.unionByName(x)
    if hits is None:
        return docs.sparkSession.createDataFrame([], d.select(*ks).schema).select(
            *[F.col(a).alias(b) for a, b in zip(ks, keys, strict=True)], F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"),
            F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"),
        )
    cand = checkpoint(hits.groupBy(*ks, "_t").agg(F.collect_set("item_id").alias("_items")))  # at most the items of the benchmark
    c = broadcast_up_to(cand.select(*[F.col(k).alias(f"c{k}") for k in ks], F.col("_t").alias("c_t"), "_items"), MAX_BROADCAST_DOCS)
    on = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in ks] + [F.col("_t") == F.col("c_t")]
    cond = on[0]
    for o in on[1:]:
        cond = cond & o
    both = d.join(c, cond).select(*ks, "_t", "_items", words_of(F.col("_text")).alias("ws"))
    full = shingles.select("item_id", "w", "shingle", F.col("n").alias("n_item"))
    found = None
    for w in widths:
        x = both.select(*ks, "_t", "_items", F.explode(F.array_distinct(_shingles(F.col("ws"), w, _text))).alias("shingle"))
        x = x.join(broadcast_up_to(full.where(F.col("w") == w).drop("w"), MAX_BROADCAST_SHINGLES), "shingle").where(F.array_contains("_items", F.col("item_id")))
        x = x.select(*ks, "_t", "item_id", "n_item", "shingle")
        found = x if found is None else found.unionByName(x)
    # repeated rows have their shingles once each; they count together
    found = found.groupBy(*ks, "_t", "item_id", "n_item").agg(F.countDistinct("shingle").alias("n_shared"))
    found = found.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    return found.select(*[F.col(a).alias(b) for a, b in zip(ks, keys, strict=True)], "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item.

    Rows are dropped by (doc_id, text), so a repeated id with another text stays, and
    equal rows go together. Null ids are ids; null and empty texts contain nothing and
    stay. Without rows in ``docs`` the result is empty, without items it is ``docs``.
    """
    own, name, bad_id, bad_name = unused(docs, "_id", "_name", "_bad_id", "_bad_name")
    bad = contained_items(docs.select("doc_id", "text", F.xxhash64("text").alias(name)), items, width, threshold, ("doc_id", name))
    bad = checkpoint(bad.select(F.col("doc_id").alias(bad_id), F.col(name).alias(bad_name)).distinct())
    bad = broadcast_up_to(bad, MAX_BROADCAST_DOCS)
    d = docs.withColumns({own: F.col("doc_id"), name: F.xxhash64("text")})
    return d.join(bad, F.col(own).eqNullSafe(F.col(bad_id)) & (F.col(name) == F.col(bad_name)), "left_anti").drop(own, name)
