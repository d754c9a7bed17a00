"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

A document is the sequence of its lines that hold a word. Lines that occur once in the
corpus cannot lie in a repeated run; the others get a line ID, and what is left of a
document are stretches of such lines. Prefix doubling ranks the suffixes of all
stretches: round j sorts them by their first 2^j lines, with the ranks of round j - 1 as
keys. Distinct keys are range-partitioned and numbered where they lie, so a rank is a
place in one global order, a frequent key is one row of the sort, and no task sees
a whole order.

A run counts if it has ``min_words`` words, so runs that count begin with one that has as
many lines as words are needed, at most; ranks beyond that depth cannot matter, and the
doubling ends there. The suffixes that share their first n lines are an interval of the
suffix array with a longest common prefix of n or more; they are those of equal ranks of
their first and of their last 2^j of these lines (2^j <= n < 2^(j+1)), which finds an
interval without a scan that crosses tasks. All members of an interval but the first in
(document, line) order are later copies. Intervals are taken at the shortest counting
runs from each line and to each line; these overlap to the maximal repeated runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import checkpoint, portions, string_bytes, unused

_IS_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


# ---- lines ------------------------------------------------------------------------


def _lines(buf: np.ndarray, offsets: np.ndarray):
    """(document, number, start, end, words) of the lines that hold a word, in order."""
    n_docs = len(offsets) - 1
    nl = np.flatnonzero(buf == 10)
    doc = np.searchsorted(offsets, nl, "right") - 1
    per = np.bincount(doc, minlength=n_docs)
    base = np.cumsum(per + 1) - (per + 1)
    start = np.empty(len(nl) + n_docs, np.int64)
    end = np.empty_like(start)
    at = np.arange(len(nl)) + doc
    start[base], end[base + per] = offsets[:-1], offsets[1:]
    start[at + 1], end[at] = nl + 1, nl
    word = ~_IS_BLANK[buf]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    opens[edge] = word[edge]
    count = np.concatenate([[0], np.cumsum(opens)])
    words = count[end] - count[start]
    own = np.repeat(np.arange(n_docs), per + 1)
    m = words > 0
    return own[m], (np.arange(len(start)) - base[own])[m], start[m], end[m], words[m]


def _line_rows(places: bool):
    """Per line its digest and, if wanted, place: document, number among the lines with words, line, words."""

    def run(batches):
        for b in batches:
            buf, offsets = string_bytes(b.column("text"))
            doc, t = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "t"))
            for i, j in portions(offsets):
                own, number, start, end, words = _lines(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data = buf[offsets[i] : offsets[j]].tobytes()
                digests = b"".join([hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                cols = {"d1": np.ascontiguousarray(d[:, 0]), "d2": np.ascontiguousarray(d[:, 1])}
                if places:
                    k = np.arange(len(own)) - np.searchsorted(own, own, "left")
                    cols |= {"doc": doc[i + own], "t": t[i + own], "k": k.astype(np.int32), "line": number.astype(np.int32), "words": words.astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))

    return run


def _id(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63)))


# ---- suffix array -----------------------------------------------------------------


def ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct ``keys`` with ``rank``: numbers in their order, distinct but not dense."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(keys.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc, t, stretch, k, line, words, rank): the repeated lines of ``docs`` (doc, t, text).

    ``rank`` is the line's ID, in order of digests; ``k`` counts a document's lines that
    hold a word, ``line`` all its lines; a stretch is consecutive in ``k``. Rows with
    equal doc and t count once.
    """
    keys = docs.mapInArrow(_line_rows(False), "d1 long, d2 long").groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1")
    ids = ranked(keys.select("d1", "d2"), "d1", "d2")
    rows = docs.mapInArrow(_line_rows(True), "d1 long, d2 long, doc long, t long, k int, line int, words int").join(ids, ["d1", "d2"])
    once = rows.groupBy("doc", "t", "k").agg(*[F.first(c).alias(c) for c in ("line", "words", "rank")])
    return once.withColumn("stretch", F.col("k") - F.row_number().over(Window.partitionBy("doc", "t").orderBy("k")))


def _shortest(words: Column, least: int) -> Column:
    """How many of an array's numbers add up to ``least``; null if all do not."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    more = lambda a, w: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n")))
    got = F.aggregate(words, start, more)
    return F.get(F.transform(F.array(got), lambda a: F.when(a["sum"] >= least, a["n"])), F.lit(0))


def intervals(ids: DataFrame, min_words: int) -> DataFrame:
    """(n, a, z, doc, t, first, last) of the counting runs of ``line_ids``, by prefix doubling.

    Runs of equal (n, a, z) are the members of one interval of the suffix array: n lines
    whose first and last 2^j have the ranks a and z. ``last`` is exclusive.
    """
    stretch = Window.partitionBy("doc", "t", "stretch")
    order = stretch.orderBy("k")
    far = max(1, min_words) - 1
    ahead = lambda c, n: F.collect_list(c).over(order.rowsBetween(0, n))
    back = lambda c, n: F.reverse(F.collect_list(c).over(order.rowsBetween(-n, 0)))
    x = ids.withColumn("f", _shortest(ahead("words", far), min_words)).withColumn("b", _shortest(back("words", far), min_words))
    # where a run goes that begins at a line, and one that ends at it
    x = x.withColumn("to", F.get(ahead("line", far), F.col("f") - 1) + 1).withColumn("from", F.get(back("line", far), F.col("b") - 1))
    x = x.withColumn("longest", F.max(F.greatest("f", "b")).over(stretch)).where("longest is not null")
    x = checkpoint(x.select("doc", "t", "stretch", "k", "line", "f", "b", "to", "from", "longest", "rank"))
    out, h = None, 1
    while not x.isEmpty():
        here = lambda n: (F.col(n) >= h) & (F.col(n) < 2 * h)  # noqa: B023, E731
        whole, half = 2 * h - 2, h - 1
        runs = x.select(
            "doc", "t",
            F.when(here("f"), F.struct(F.col("f").alias("n"), F.col("rank").alias("a"), F.get(ahead("rank", half), F.col("f") - h).alias("z"), F.col("line").alias("first"), F.col("to").alias("last"))).alias("x"),
            F.when(here("b"), F.struct(F.col("b").alias("n"), F.get(back("rank", whole), F.col("b") - 1).alias("a"), F.get(back("rank", whole), F.lit(half)).alias("z"), F.col("from").alias("first"), (F.col("line") + 1).alias("last"))).alias("y"),
        )
        runs = runs.select("doc", "t", F.explode(F.array_distinct(F.array("x", "y"))).alias("r")).where("r is not null").select("r.n", "r.a", "r.z", "doc", "t", "r.first", "r.last")
        runs = checkpoint(runs)
        out = runs if out is None else out.unionByName(runs)
        # the next round: suffixes by the ranks of their first h lines and of the h lines after
        x = x.where(F.col("longest") >= 2 * h)
        after = F.when(F.lead("k", h).over(order) == F.col("k") + h, F.lead("rank", h).over(order))
        x = x.withColumn("after", F.coalesce(after, F.lit(-1)))
        keys = ranked(x.select("rank", "after").distinct().toDF("r1", "r2"), "r1", "r2")
        x = checkpoint(x.join(keys, (F.col("r1") == x["rank"]) & (F.col("r2") == x["after"])).select(*[x[c] for c in x.columns if c not in ("rank", "after")], keys["rank"]))
        h *= 2
    return out


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(doc, t, first, last): runs of lines of ``docs`` that are later copies.

    ``doc`` is the id (null: the least long), ``t`` the text's hash, which orders
    rows that share an id; rows with equal id and text are one document. Lines count
    from 0, ``last`` is exclusive. Without repeated lines, as in an empty table, there
    are no rows.
    """
    runs = intervals(line_ids(docs.select(_id().alias("doc"), F.xxhash64("text").alias("t"), "text")), min_words)
    if runs is None:
        return docs.sparkSession.createDataFrame([], "doc long, t long, first int, last int")
    # the first of each interval; partial minima keep a passage that many documents share small
    least = runs.groupBy("n", "a", "z").agg(F.min(F.struct("doc", "t", "first")).alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    least = checkpoint(least)  # Spark splits a skewed join only right above its exchanges
    return runs.join(least, ["n", "a", "z"]).where(F.struct("doc", "t", "first") > F.col("least")).select("doc", "t", "first", "last")


# ---- texts ------------------------------------------------------------------------


def _cut(text: str | None, spans) -> tuple[str | None, int]:
    """The text without the spans' lines that hold a word, and how many those were."""
    if not text or not spans:
        return text, 0
    lines = text.split("\n")
    gone = set()
    for s in spans:
        gone.update(i for i in range(s["first"], s["last"]) if lines[i].strip(" \t\n\x0b\f\r"))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def _cutter(batches):
    for b in batches:
        text, spans = b.column("_text"), b.column("_spans")
        has = pc.is_valid(spans)
        out = [_cut(t, s) for t, s in zip(text.filter(has).to_pylist(), spans.filter(has).to_pylist(), strict=True)]
        removed = pc.replace_with_mask(pa.array(np.zeros(b.num_rows, np.int64)), has, pa.array([x[1] for x in out], pa.int64()))
        text = pc.replace_with_mask(text, has, pa.array([x[0] for x in out], text.type))
        yield pa.RecordBatch.from_arrays([b.column("_row"), text, removed], names=["_row", "_text", "_removed"])


def dedup_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, with later copies of line runs cut from ``text``.

    A line that holds a word is cut if it lies in a run of consecutive such lines
    that has ``min_words`` words or more and also starts earlier (smaller doc_id, or
    same document and earlier line); overlaps count and runs are judged on the input.
    Lines without a word neither count nor break a run, and stay. ``n_removed_lines``
    is added, in place of a column of that name; of a document whose lines all went, an
    empty or blank text remains. Null texts stay null. Null ids order first; rows of one
    id are ordered by their texts' hash. An empty table gives an empty result.
    """
    spans = repeated_runs(docs, min_words).groupBy("doc", "t").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))  # at most two per line
    spans = spans.select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), "_spans")
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias(unused(docs, "_")[0]))  # the text travels once
    packed = docs.select(rest.alias("_row"), _id().alias("_key"), F.xxhash64("text").alias("_name"), F.col("text").alias("_text"))
    both = packed.join(spans, (F.col("_key") == F.col("_doc")) & (F.col("_name") == F.col("_t")), "left").select("_row", "_text", "_spans")
    row = both.schema["_row"].dataType.simpleString()
    out = both.mapInArrow(_cutter, f"_row {row}, _text string, _removed long")
    taken = "n_removed_lines"
    cells = [F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c != taken]
    return out.select(*cells, F.col("_removed").alias(taken))
