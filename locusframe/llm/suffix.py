"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

The suffix array is made by two-stage sorting: only suffixes smaller than their
successors are sorted directly; the others follow by scanning the buckets of first bytes
in ascending order, each suffix placing its predecessor. Common prefixes of neighbours
in the array then give the classes of equal ``length``-byte strings, of which all but the
earliest start are copies.

So that a corpus can be sorted in parts, every ``length``-byte window is named by the
least hash of its 16-byte grams. Equal windows have equal names, and neighbouring windows
mostly share one, so a document falls into segments of some 40 windows. Only segments
whose name occurs elsewhere can repeat; those are gathered by name, equal segments once,
and each task builds suffix arrays over whole names. Names of very many segments would
outgrow a task; their windows are hashed and grouped instead, which combines on the map
side. The result is that of one suffix array over the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_up_to, checkpoint, portions, string_bytes

GRAM = 16
LENGTH = 100
MOST = 4095  # windows of a segment
#: Names of more segments are compared window by window; so many such names are broadcast at most.
HOT, MAX_BROADCAST_NAMES = 1 << 16, 1_000_000
SORT = 1 << 20  # bytes of segments that are sorted at once; a single name may exceed it
_BYTE = np.random.default_rng(0x5EED).integers(0, 2**64, 256, dtype=np.uint64)  # a fixed table
_BASE = 0x9E3779B97F4A7C15


# ---- names and segments -----------------------------------------------------------


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position."""
    h, reach = _BYTE[buf], 1
    while reach < GRAM:
        step = np.uint64(pow(_BASE, reach, 1 << 64))
        h = h[:-reach] * step + h[reach:]
        reach *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position."""
    m, reach = h, 1
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(name, start, windows, repeats) of the segments of the texts [start, end) in ``buf``.

    ``repeats``: the name's gram occurs twice, so windows of the segment may be equal.
    """
    width = length - GRAM + 1
    none = np.empty(0, np.int64)
    long = ends - starts >= length
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.empty(0, np.uint64), none, none, np.empty(0, bool)
    h = _grams(buf)
    m = _least(h, width)
    edge = np.zeros(len(m) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, ends - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    new[starts] = True
    stop = ~valid
    first = np.flatnonzero(new)
    # a segment ends where the next begins or the windows of its text end
    bounds = np.flatnonzero(new | stop)
    after = np.append(bounds, len(m))[np.searchsorted(bounds, first, "right")]
    n = after - first
    if (n > MOST).any():
        pieces = -(-n // MOST)
        base = np.repeat(first, pieces)
        k = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop_at = np.repeat(after, pieces)
        repeated = np.repeat(n > MOST, pieces)
        first = base + k * MOST
        n = np.minimum(first + MOST, stop_at) - first
    else:
        repeated = np.zeros(len(first), bool)
    name = m[first]
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    twice = repeated | (n > width)
    for i in range(0, len(first), 20_000):
        s = slice(i, i + 20_000)
        a, b = first[s], first[s] + n[s] - 1
        head, tail = view[a] == name[s, None], view[b] == name[s, None]
        twice[s] |= (head.sum(1) > 1) | (tail.sum(1) > 1) | (a + head.argmax(1) != b + tail.argmax(1))
    return name, first, n, twice


def digests(data: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """BLAKE2b digests (n, 2) of 128 bits of ranges of bytes."""
    raw = b"".join([hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(first.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _named(length: int, places: bool):
    def run(batches):
        for b in batches:
            buf, offsets = string_bytes(b.column("text"))
            if places:
                doc, t = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "t"))
            for i, j in portions(offsets):
                o = offsets[i : j + 1] - offsets[i]
                name, first, n, twice = segments(buf[offsets[i] : offsets[j]], o[:-1], o[1:], length)
                if not len(name):
                    continue
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([name, name[twice]]).view(np.int64))], names=["h"])
                    continue
                own = np.searchsorted(o, first, "right") - 1
                at = ((first - o[own]) << 13) | (n << 1) | twice
                s = digests(buf[offsets[i] : offsets[j]].tobytes(), first, first + n + length - 1)
                cols = (name.view(np.int64), s[:, 0], s[:, 1], doc[i + own], t[i + own], at)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h", "s", "s2", "doc", "t", "at"])

    return run


def _unpack(at: np.ndarray):
    """(first byte, windows, repeats) of packed places."""
    return at >> 13, (at >> 1) & 0xFFF, (at & 1).astype(bool)


# ---- two-stage suffix sorting ------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number."""
    w = np.zeros(len(text) + 8, np.uint64)
    w[: len(text)] = text
    for reach, bits in ((1, 8), (2, 16), (4, 32)):
        w[:-reach] = (w[:-reach] << np.uint64(bits)) | w[reach:]
    return w[: len(text)]


def _sort_directly(which: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, refined eight bytes at a time."""
    n, limit = len(which), len(words)
    order = which[np.argsort(words[which], kind="stable")]
    same = words[order[1:]] == words[order[:-1]]
    at = 8
    while at < depth and same.any():
        # members of groups that are still equal
        inside = np.zeros(n, bool)
        inside[1:] |= same
        inside[:-1] |= same
        place = np.flatnonzero(inside)
        head = np.ones(n, bool)
        head[1:] = ~same
        group = np.cumsum(head)[place]
        p = order[place] + at
        key = np.where(p < limit, words[np.minimum(p, limit - 1)], 0)
        sub = np.lexsort((key, group))
        order[place] = order[place][sub]
        key = key[sub]
        equal = np.zeros(n, bool)
        both = np.flatnonzero((group[1:] == group[:-1]) & (key[1:] == key[:-1]))
        equal[place[both]] = True  # place[both] and its successor in the array
        same = equal[: n - 1]
        at += 8
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes), sorted by ``depth`` bytes at least.

    Stage one sorts the suffixes smaller than their successors directly. Stage two scans
    buckets of first bytes upwards: a suffix already placed puts its predecessor, if
    that is larger than it, at the end of what its bucket has so far.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    nxt = np.append(text[1:], 0).astype(np.int16)
    cmp = np.sign(text.astype(np.int16) - nxt).astype(np.int8)
    cmp[-1] = 1  # the last suffix is larger than the empty one
    known = np.flatnonzero(cmp)
    cmp = cmp[known[np.searchsorted(known, np.arange(n))]]  # equal bytes: as the next suffix
    larger = cmp > 0
    small = np.flatnonzero(~larger)
    direct = _sort_directly(small, _words(text), depth) if len(small) else small
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the predecessor of the empty suffix
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        bucket = []
        while len(wave):  # runs of the byte c place one another
            bucket.append(wave)
            prev = wave[wave > 0] - 1
            wave = prev[larger[prev] & (text[prev] == c)]
        bucket.append(direct[cut[c] : cut[c + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        out.append(done)
        prev = done[done > 0] - 1
        prev = prev[larger[prev] & (text[prev] > c)]
        if len(prev):
            first = text[prev]
            order = np.argsort(first, kind="stable")
            prev, first = prev[order], first[order]
            edges = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for e, piece in zip(edges, np.split(prev, edges[1:]), strict=True):
                waiting[first[e]].append(piece)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Bytes that neighbours of a suffix array have in common, up to ``most`` (a multiple of 4)."""
    a, b = array[:-1], array[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    limit = len(words)
    for at in range(0, most, 8):
        p, q = a[live] + at, b[live] + at
        fits = (p < limit) & (q < limit)
        live, p, q = live[fits], p[fits], q[fits]
        x = words[p] ^ words[q]
        same = x == 0
        y = x[~same]
        # leading equal bytes
        lead = np.zeros(len(y), np.int64)
        for k in range(7, 0, -1):
            lead += (y >> np.uint64(8 * k)) == 0
        out[live[~same]] = at + lead
        live = live[same]
        out[live] = at + 8
    return np.minimum(out, most)


def copies(parts: list[bytes], windows: np.ndarray, order: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per part, which of its first ``windows`` windows also start earlier.

    ``order`` ranks the parts' first windows: window w of part i starts at (rank i, w)
    if the parts lie in different places; parts of one document are ranked by place.
    """
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(parts), np.uint8)
    array = suffix_array(text, length)
    words = _words(text)
    own = np.repeat(np.arange(len(parts)), size)
    offset = np.arange(len(text)) - begin[own]
    ok = offset < windows[own]
    # equal strings are neighbours; what is not a window only separates nothing and is left out
    lcp = common_prefixes(words, array, length)
    cls = np.cumsum(np.concatenate([[True], lcp < length])) - 1
    keep = ok[array]
    array, cls = array[keep], cls[keep]
    place = order[own[array]] + offset[array]
    head = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.empty(0, np.int64)
    least = np.minimum.reduceat(place, head) if len(head) else place
    bad = place > np.repeat(least, np.diff(np.append(head, len(cls))))
    flag = np.zeros(len(text), bool)
    flag[array[bad]] = True
    return [flag[s : s + w] for s, w in zip(begin.tolist(), windows.tolist(), strict=True)]


def _sorted_copies(length: int):
    schema = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("at", pa.int64())])

    def part(h, seg, doc, t, at):
        first, n, _ = _unpack(at)
        # places as ranks with room for the windows between them: (doc, t, byte)
        by = np.lexsort((first, t, doc))
        new = np.append(True, (doc[by][1:] != doc[by][:-1]) | (t[by][1:] != t[by][:-1]))
        base = np.empty(len(by), np.int64)
        base[by] = (np.cumsum(new) - 1) << 32
        flags = copies(seg, n, base + first, length)
        rows = []
        for i, f in enumerate(flags):
            if f.any():
                e = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
                for a, z in zip(e[::2].tolist(), e[1::2].tolist(), strict=True):
                    rows.append((int(doc[i]), int(t[i]), ((int(first[i]) + a) << 13) | ((z - a) << 1)))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        h, doc, t, at = (table.column(k).to_numpy() for k in ("h", "doc", "t", "at"))
        order = np.argsort(h, kind="stable")
        h = h[order]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(heads, len(h)))
        twice = _unpack(at[order])[2]
        # a name with one segment that does not repeat inside has nothing to compare
        live = np.repeat((count > 1) | twice[heads], count)
        order, h = order[live], h[live]
        if not len(h):
            return
        seg = table.column("seg").take(pa.array(order))
        size = seg.combine_chunks() if isinstance(seg, pa.ChunkedArray) else seg
        length_of = pa.compute.binary_length(size).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.append(np.add.reduceat(length_of, heads).cumsum(), 0)
        i = 0
        while i < len(heads):
            before = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total[:-1], before + SORT, "right")))
            s = slice(heads[i], heads[j] if j < len(heads) else len(h))
            yield from part(h[s], size[s.start : s.stop].to_pylist(), doc[order[s]], t[order[s]], at[order[s]])
            i = j

    return run


# ---- spans and texts ---------------------------------------------------------------


def _packed(batches):
    """Texts as compressed bytes: half of what the shuffle would make of them."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        z = [pack.compress(x.encode("utf-8", "surrogatepass")) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(k) for k in ("doc_id", "doc", "t")] + [pa.array(z, pa.binary())], names=["doc_id", "doc", "t", "z"])


def _cut_out(length: int):
    """Per segment its name, place and bytes."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("at", pa.int64()), ("seg", pa.binary())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            segs: list[bytes] = []
            own: list[np.ndarray] = []
            for k, (z, hits) in enumerate(zip(b.column("z").to_pylist(), b.column("hits"), strict=True)):
                raw = unpack.decompress(z)
                first, n, _ = _unpack(hits.values.field(1).to_numpy())
                segs += [raw[a:e] for a, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]
                own.append(np.full(len(first), k))
            if segs:
                flat = b.column("hits").flatten()
                doc, t = (b.column(k).take(pa.array(np.concatenate(own))) for k in ("doc", "t"))
                yield pa.RecordBatch.from_arrays([flat.field(0), doc, t, flat.field(1), pa.array(segs, pa.binary())], schema=schema)

    return run


def _windows(length: int):
    """Per window of the segments ``hits`` a 128-bit hash of its bytes, and its place."""
    schema = pa.schema([("k", pa.binary()), ("doc", pa.int64()), ("t", pa.int64()), ("at", pa.int64())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for z, doc, t, hits in zip(b.column("z").to_pylist(), b.column("doc").to_pylist(), b.column("t").to_pylist(), b.column("hits"), strict=True):
                raw = unpack.decompress(z)
                first, n, _ = _unpack(hits.values.field(1).to_numpy())
                at = np.concatenate([np.arange(a, a + m) for a, m in zip(first.tolist(), n.tolist(), strict=True)])
                for i in range(0, len(at), 50_000):
                    part = at[i : i + 50_000]
                    keys = [hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in part.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), t)), pa.array((part << 13) | (1 << 1))], schema=schema
                    )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _remove(length: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            n_bytes, removed, runs, kept = [], [], [], []
            for z, places in zip(b.column("z").to_pylist(), b.column("places"), strict=True):
                data = unpack.decompress(z)
                cut = []
                if places.is_valid:
                    first, n, _ = _unpack(places.values.to_numpy())
                    cut = merged(list(zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)))
                at, pieces = 0, []
                for a, z in cut:
                    pieces.append(data[at:a])
                    at = z
                pieces.append(data[at:])
                n_bytes.append(len(data))
                removed.append(sum(z - a for a, z in cut))
                runs.append([list(x) for x in cut])
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def _copies_and_firsts(occ: DataFrame, hot: bool) -> tuple[DataFrame, DataFrame]:
    """Of segments (h, s, s2, doc, t, at): (doc, t, at) of all but the first of equal ones, and the firsts.

    As ``occ`` is partitioned by name, the first of at most ``HOT`` is looked up in place,
    without a shuffle; for more, partial minima are joined back, and Spark splits the join.
    """
    place = F.struct("doc", "t", "at")
    if hot:
        first = occ.groupBy("h", "s", "s2").agg(F.min(place).alias("least"))
        later = occ.join(first, ["h", "s", "s2"]).where(place > F.col("least"))
        return later.select("doc", "t", "at"), first.select("h", "least.doc", "least.t", "least.at")
    x = occ.withColumn("least", F.min(place).over(Window.partitionBy("h", "s", "s2")))
    return x.where(place > F.col("least")).select("doc", "t", "at"), x.where(place == F.col("least")).select("h", "doc", "t", "at")


def _with_hits(packed: DataFrame, segs: DataFrame) -> DataFrame:
    """The texts that have some of ``segs`` (h, doc, t, at), each with its own as ``hits``."""
    hits = segs.groupBy("doc", "t").agg(F.collect_list(F.struct("h", "at")).alias("hits"))  # at most the document's segments
    return packed.join(hits, ["doc", "t"]).select("doc_id", "doc", "t", "z", "hits")  # all columns, so that the exchange is reused


def repeated_places(docs: DataFrame, packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, t, at): packed places in ``docs`` (doc, t, text) whose windows also start earlier.

    ``packed`` has the same texts compressed. A segment is told from others of its name
    by a BLAKE2b digest of its bytes, of 128 bits besides the name's 64. A name's segments are compared where
    the name is; those of more than ``HOT`` are not gathered, but each of their windows is
    grouped with its equals.
    """
    names = docs.select("text").mapInArrow(_named(length, False), "h long")
    often = checkpoint(names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    places = docs.select("doc", "t", "text").mapInArrow(_named(length, True), "h long, s long, s2 long, doc long, t long, at long")
    # never null; said here, because the optimiser would say it in some branches only, and
    # exchanges that differ in a filter are not reused
    places = places.where("h is not null and s is not null and s2 is not null and doc is not null and t is not null and at is not null")
    later, first = _copies_and_firsts(places.join(often.where(F.col("n") <= HOT).select("h").hint("merge"), "h"), False)
    # bytes are gathered for names that have several segments, or one that may repeat inside
    several = first.groupBy("h").agg(F.count("*").alias("n"), F.max(F.col("at").bitwiseAND(F.lit(1))).alias("twice")).where("n > 1 or twice = 1").select("h")
    hits = first.join(several.hint("merge"), "h").select("h", "doc", "t", "at")
    both = _with_hits(packed, hits)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = both.mapInArrow(_cut_out(length), "h long, doc long, t long, at long, seg binary").repartition(n, "h")
    out = sets.mapInArrow(_sorted_copies(length), "doc long, t long, at long").unionByName(later)
    hot = often.where(F.col("n") > HOT).select("h")
    if hot.isEmpty():
        return out
    later, first = _copies_and_firsts(places.join(broadcast_up_to(hot, MAX_BROADCAST_NAMES), "h"), True)
    each = _with_hits(packed, first).mapInArrow(_windows(length), "k binary, doc long, t long, at long")
    place = F.struct("doc", "t", "at")
    least = each.groupBy("k").agg(F.min(place).alias("least"))
    return out.unionByName(later).unionByName(each.join(least, "k").where(place > F.col("least")).select("doc", "t", "at"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs), kept (bytes), per row of ``docs``.

    A byte is removed if a ``length``-byte string covers it that also starts earlier
    (smaller doc_id, or same document and earlier start). Texts are judged as UTF-8 bytes
    on the input; null texts are empty, shorter texts stay whole. Null ids order
    first. Rows of an id that stands more than once are told apart and ordered by the
    64-bit hash of their texts; rows with equal id and text count as one document. An
    empty table gives no rows; other columns are not read. ``kept`` need not be valid
    UTF-8.
    """
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    twice = checkpoint(d.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("twice")))
    # ids that stand once need no hash, and a constant costs the shuffles nothing
    if twice.isEmpty():
        d = d.withColumn("t", F.lit(0).cast("long"))
    else:
        d = d.join(broadcast_up_to(twice, MAX_BROADCAST_NAMES), "doc", "left").withColumn("t", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("twice")
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = d.select("doc_id", "doc", "t", "text").mapInArrow(_packed, f"doc_id {kind}, doc long, t long, z binary")
    packed = packed.where("doc is not null and t is not null")  # never null; for the exchange's reuse
    places = repeated_places(d, packed, length).groupBy("doc", "t").agg(F.collect_list("at").alias("places"))
    both = packed.join(places, ["doc", "t"], "left").select("doc_id", "z", "places")
    return both.mapInArrow(_remove(length), f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
