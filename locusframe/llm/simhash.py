"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are routed by pigeonhole: of ``b`` disjoint bit blocks two fingerprints
within ``max_bits`` bits agree on ``b - max_bits`` at least, so each is sent once for every
choice of so many blocks, to the group of their values. More blocks make wider keys; their
number follows the corpus, so that groups stay small. A task sorts the fingerprints of a
group by Gray rank, so that neighbours share most bits, and builds an index bottom-up:
eight neighbours form a node that factors out the bits all of them share (a mask and a
pattern). The index is joined with itself from the roots down; a pair of nodes is pruned
as soon as the shared patterns alone differ in more than ``max_bits``, and whole groups are
linked at once if even the bits not shared cannot take them further apart. Links leave a
task as a spanning forest, at most one per fingerprint, and connected components join them.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import BLANKS, broadcast_up_to, checkpoint, connected_components, unused

FAN = 8
#: A routing group beyond so many fingerprints is dealt out as pairs of chunks.
MAX_GROUP = 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints -----------------------------------------------------------------


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, repeats included."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:z], 42) for a, z in zip(start, end[width - 1 :].tolist(), strict=True)], np.uint64, n - width + 1)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash; the first is the hash itself."""
    if k == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _prints(width: int, n_codes: int):
    def run(batches):
        for b in batches:
            codes = np.zeros((b.num_rows, n_codes), np.uint64)
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                h = shingle_hashes(text, width)
                for k in range(n_codes):
                    codes[i, k] = fingerprint(_mix(h, k))
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(codes[:, k].view(np.int64)) for k in range(n_codes)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], *(f"w{k}" for k in range(n_codes))])

    return run


def fingerprints(docs: DataFrame, width: int = 4, n_codes: int = 1, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the fingerprint's 64-bit words w0, w1, ... as signed longs, per row."""
    d = docs.select(*keys, "text")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(_prints(width, n_codes), types + "".join(f", w{k} long" for k in range(n_codes)))


# ---- index and self-join ----------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    g = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return g


def _far(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=1, dtype=np.int64)


class _Forest:
    """Union-find whose labels are the least member; links become spanning edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """Joins a and b; of links between two components the shortest stay (Boruvka)."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            m = la != lb
            a, b, d, la, lb = a[m], b[m], d[m], la[m], lb[m]
            if not len(a):
                return
            side, at = np.concatenate([la, lb]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((at, d[at], side))
            pick = np.unique(at[order[np.concatenate([[True], side[order][1:] != side[order][:-1]])]])
            for i in pick.tolist():
                x, y = self.find(int(a[i])), self.find(int(b[i]))
                if x != y:
                    self.label[max(x, y)] = min(x, y)
                    self.edges.append((int(a[i]), int(b[i]), int(d[i])))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def find(self, x: int) -> int:
        while self.label[x] != x:
            x = int(self.label[x])
        return x


def _index(codes: np.ndarray, group: np.ndarray) -> tuple[list, list, list, list, list]:
    """Levels of nodes: AND and OR of their codes, the range of leaves and children, and the group."""
    ands, ors, lo, kids, own = [codes], [codes], [np.arange(len(codes) + 1)], [None], [group]
    while True:
        g = own[-1]
        first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.empty(0, np.int64)
        starts = np.flatnonzero((np.arange(len(g)) - begin) % FAN == 0)
        if len(starts) == len(g):
            break
        ands.append(np.bitwise_and.reduceat(ands[-1], starts, axis=0))
        ors.append(np.bitwise_or.reduceat(ors[-1], starts, axis=0))
        kids.append(np.append(starts, len(g)))
        lo.append(lo[-1][kids[-1]])
        own.append(g[starts])
    return ands, ors, lo, kids, own


def _children(kids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; a node meets itself once."""
    ka, kb = kids[a], kids[b]
    na, nb = kids[a + 1] - ka, kids[b + 1] - kb
    i, j = np.arange(FAN)[None, :, None], np.arange(FAN)[None, None, :]
    ok = (i < na[:, None, None]) & (j < nb[:, None, None]) & ((a != b)[:, None, None] | (i <= j))
    return np.broadcast_to(ka[:, None, None] + i, ok.shape)[ok], np.broadcast_to(kb[:, None, None] + j, ok.shape)[ok]


def link_codes(codes: np.ndarray, group: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, list]:
    """Spanning links (i, j, bits) among codes of one group at ``steps[-1]`` bits or fewer.

    ``codes`` is (n, words). Steps go from near to far, so that the forest prefers
    short links; i and j count in the Gray order that is returned with them.
    """
    n = len(codes)
    keys = [gray_rank(codes[:, k]) for k in reversed(range(codes.shape[1]))]
    order = np.lexsort((*keys, group))
    codes, group = codes[order], group[order]
    forest = _Forest(n)
    for gap in range(1, min(4, n)):  # Gray neighbours first: what is linked is pruned below
        i = np.flatnonzero(group[gap:] == group[:-gap])
        d = _far(codes[i] ^ codes[i + gap])
        m = d <= steps[0]
        forest.link(i[m], i[m] + gap, d[m])
    ands, ors, lo, kids, own = _index(codes, group)
    top = len(ands) - 1
    for step in steps:
        roots = np.arange(len(own[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 40_000:
                h = len(a) // 2
                stack += [(level, a[:h], b[:h]), (level, a[h:], b[h:])]
                continue
            # whole groups that the shared patterns keep apart
            apart = _far((ands[level][a] & ~ors[level][b]) | (ands[level][b] & ~ors[level][a]))
            m = apart <= step
            a, b, apart = a[m], b[m], apart[m]
            if level == 0:
                m = a != b
                forest.link(a[m], b[m], apart[m])
                continue
            # groups that are one component already have nothing to add
            la = np.minimum.reduceat(forest.label, lo[level][:-1])
            ha = np.maximum.reduceat(forest.label, lo[level][:-1])
            m = ~((la[a] == ha[a]) & (la[b] == ha[b]) & (la[a] == la[b]))
            a, b = a[m], b[m]
            if not len(a):
                continue
            # groups that not even the bits they do not share take apart
            most = _far((ors[level][a] & ~ands[level][b]) | (ors[level][b] & ~ands[level][a]))
            near = most <= step
            if near.any():
                x, y = a[near], b[near]
                for p, q in ((x, y), (y, x)):  # the first code of one with all codes of the other
                    size = lo[level][q + 1] - lo[level][q]
                    i = np.repeat(lo[level][p], size)
                    j = np.repeat(lo[level][q] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    m = i != j
                    forest.link(i[m], j[m], _far(codes[i[m]] ^ codes[j[m]]))
            a, b = a[~near], b[~near]
            x, y = _children(kids[level], a, b)
            if len(x):
                stack.append((level - 1, x, y))
    return order, forest.edges


def near_pairs(codes: np.ndarray, group: np.ndarray, most: int, settled):
    """Pairs (i, j) of codes of one group at ``most`` bits or fewer, in batches.

    ``settled(lo)`` says of the nodes that begin at the leaves ``lo`` which pairs
    need not be looked into; it is asked anew for every batch, so what a caller learns
    from one batch prunes the next. Codes have to come sorted by group.
    """
    ands, ors, lo, kids, own = _index(codes, group)
    roots = np.arange(len(own[-1]))  # levels grow until each group is one node
    stack = [(len(ands) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 40_000:
            h = len(a) // 2
            stack += [(level, a[:h], b[:h]), (level, a[h:], b[h:])]
            continue
        m = _far((ands[level][a] & ~ors[level][b]) | (ands[level][b] & ~ors[level][a])) <= most
        a, b = a[m], b[m]
        m = ~settled(lo[level][:-1], a, b)
        a, b = a[m], b[m]
        if not len(a):
            continue
        if level == 0:
            m = a != b
            yield a[m], b[m]
            continue
        x, y = _children(kids[level], a, b)
        if len(x):
            stack.append((level - 1, x, y))


def _gray_sorted(t: pa.Table, n_codes: int):
    """The rows of a task by group and Gray order: table, codes, number of the group."""
    codes = np.stack([t.column(f"w{k}").to_numpy().view(np.uint64) for k in range(n_codes)], 1)
    # a group is a key, its value and, for large groups, a pair of chunks
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("block", "value", "part")], 1)
    group = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((*[gray_rank(codes[:, k]) for k in reversed(range(n_codes))], group))
    return t.take(pa.array(order)), codes[order], group[order]


def _once(t: pa.Table, codes: np.ndarray, masks: np.ndarray):
    """Whether a pair of rows counts where it stands: in the first key it agrees on, and in one pair of chunks."""
    block, chunk, part = (t.column(c).to_numpy() for c in ("block", "chunk", "part"))

    def test(i, j):
        key = np.zeros(len(i), np.int64)
        for r in range(0, len(i), 4096):  # pairs times keys, so some pairs at a time
            differ = (codes[i[r : r + 4096]] ^ codes[j[r : r + 4096]])[:, None, :] & masks
            key[r : r + 4096] = (~differ.any(axis=2)).argmax(axis=1)
        # rows of one chunk meet in all its pairs, and count in that with itself
        return (key == block[i]) & ((chunk[i] != chunk[j]) | (part[i] == chunk[i] * (CHUNKS + 1)))

    return test


def _linker(n_codes: int, steps: tuple[int, ...], carried: tuple[str, ...]):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, codes, group = _gray_sorted(pa.Table.from_batches(got), n_codes)
        order, edges = link_codes(codes, group, steps)
        if edges:
            e = np.array(edges)
            src, dst = (t.select(list(carried)).take(pa.array(order[e[:, i]])) for i in (0, 1))
            cols = [c.combine_chunks() for x in (src, dst) for c in x.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(e[:, 2].astype(np.int32))], names=[*(f"s_{c}" for c in carried), *(f"d_{c}" for c in carried), "bits"])

    return run


def _marker(n_codes: int, most: int, masks: np.ndarray):
    """The rows that are near another of their group, by the codes alone."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, codes, group = _gray_sorted(pa.Table.from_batches(got), n_codes)
        once, marked = _once(t, codes, masks), np.zeros(len(codes), bool)

        def settled(lo, a, b):  # what is marked already learns nothing more
            all_of = np.logical_and.reduceat(marked, lo)
            return all_of[a] & all_of[b]

        for i, j in near_pairs(codes, group, most, settled):
            m = once(i, j)
            marked[i[m]] = True
            marked[j[m]] = True
        yield from t.filter(pa.array(marked)).combine_chunks().to_batches()

    return run


def _complete_groups(batches):
    """Tables of whole groups, from batches sorted by group, of as few rows as their ends allow."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "value", "part")], 1)
        last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        if held and not last and any(held[-1].column(c)[-1] != b.column(c)[0] for c in ("block", "value", "part")):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _verifier(n_codes: int, most: int, masks: np.ndarray, similarity: float):
    """Spanning links of a group's texts of that Jaccard similarity, from codes and shingle sets."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(t, codes, group, sets):
        once, forest = _once(t, codes, masks), _Forest(len(codes))
        size = np.fromiter(map(len, sets), np.int64, len(sets))

        def settled(lo, a, b):  # what verified links have joined needs no other link
            low, high = np.minimum.reduceat(forest.label, lo), np.maximum.reduceat(forest.label, lo)
            return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

        for i, j in near_pairs(codes, group, most, settled):
            m = once(i, j) & (np.minimum(size[i], size[j]) / np.maximum(size[i], size[j]) >= similarity)
            i, j = i[m], j[m]
            if not len(i):
                continue
            order = np.lexsort((_far(codes[i] ^ codes[j]), i))
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for a, z in zip(starts.tolist(), np.append(starts[1:], len(i)).tolist(), strict=True):
                # one text against its candidates that are not of its component
                p = int(i[a])
                own = forest.find(p)
                q = np.array([x for x in j[a:z].tolist() if forest.find(x) != own], np.int64)
                if not len(q):
                    continue
                for r in range(0, len(q), 256):
                    part = q[r : r + 256]
                    flat = np.concatenate([sets[x] for x in part.tolist()])
                    at = np.searchsorted(sets[p], flat)
                    hit = np.append(sets[p], sets[p][-1:])[at] == flat
                    both = np.add.reduceat(hit, np.cumsum(size[part]) - size[part])
                    ok = part[both / (size[p] + size[part] - both) >= similarity]
                    forest.link(np.full(len(ok), p), ok, np.zeros(len(ok), np.int64))
        return forest.edges

    def run(batches):
        for t in _complete_groups(batches):
            # the sets stay where they came in; only views of them are put in order
            views = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
            t = t.drop_columns(["hashes"]).append_column("row", pa.array(np.arange(len(t))))
            t, codes, group = _gray_sorted(t, n_codes)
            if edges := links(t, codes, group, [views[i] for i in t.column("row").to_pylist()]):
                e = np.array(edges)
                node = t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]])], schema=schema)

    return run


# ---- routing ----------------------------------------------------------------------


def _bounds(n_codes: int, blocks: int) -> list[tuple[int, int]]:
    """The first bit of each block and the bit after its last."""
    edges = np.linspace(0, 64 * n_codes, blocks + 1).round().astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def exact_keys(n: int, max_bits: int, per_group: int = 2048) -> list[tuple[int, ...]]:
    """Choices of blocks by which 64-bit codes within ``max_bits`` bits surely meet.

    Of ``b`` blocks any ``b - max_bits`` make a key. The fewest blocks are taken
    whose keys deal ``n`` evenly spread codes out to groups of ``per_group`` at most: 5 keys of
    13 bits, then 15 of 21, 35 of 27, 70 of 32 for 4 bits.
    """
    b = max_bits + 1
    while b < 2 * max_bits and n >> (64 * (b - max_bits) // b) > per_group:
        b += 1
    return [(b, *c) for c in combinations(range(b), b - max_bits)]


def likely_keys(n: int, far: int, miss: float, per_group: int) -> list[tuple[int, ...]]:
    """Choices of blocks by which 256-bit codes ``far`` bits apart meet but for a share ``miss``.

    Up to ``per_group`` codes a value, each of 22 blocks is a key of 12 bits. A larger ``n``
    gets keys of 16, 20, ... bits, so that groups do not grow with the corpus: blocks of
    4 bits are dealt out in permutations, and there are as many keys as ``miss`` asks for.
    """
    if n >> 12 <= per_group:
        return [(BLOCKS, i) for i in range(BLOCKS)]
    size = 4
    while n >> (4 * size) > per_group:
        size += 1
    b, rng, keys, wanted = 16 * CODES, np.random.default_rng(0), [], 1
    # the share of pairs by how many blocks their far bits touch, and of keys that such a pair agrees on
    touch = [sum((-1) ** j * math.comb(t, j) * math.comb(4 * (t - j), far) for j in range(t + 1)) * math.comb(b, t) / math.comb(4 * b, far) for t in range(b + 1)]
    agree = [math.comb(b - t, size) / math.comb(b, size) for t in range(b + 1)]
    while sum(p * (1 - a) ** wanted for p, a in zip(touch, agree, strict=True)) > miss:
        wanted += 1
    while len(keys) < wanted:
        order = rng.permutation(b).tolist()
        keys += [(b, *sorted(order[i : i + size])) for i in range(0, b - size + 1, size)]
    return keys[:wanted]


def _value(n_codes: int, key: tuple[int, ...]):
    """The bits of a key's blocks as one number; ``key`` is the number of blocks and those chosen."""
    bounds = _bounds(n_codes, key[0])
    out = None
    for at, hi in (bounds[i] for i in key[1:]):
        while at < hi:
            k, s = divmod(at, 64)
            w = min(hi - at, 64 - s)
            v = F.shiftrightunsigned(f"w{k}", 64 - s - w).bitwiseAND(F.lit((1 << w) - 1)) if w < 64 else F.col(f"w{k}")
            out = v if out is None else F.shiftleft(out, w).bitwiseOR(v)
            at += w
    return out


def _masks(n_codes: int, keys: list[tuple[int, ...]]) -> np.ndarray:
    masks = np.zeros((len(keys), n_codes), np.uint64)
    for i, key in enumerate(keys):
        for lo, hi in (_bounds(n_codes, key[0])[x] for x in key[1:]):
            for bit in range(lo, hi):
                masks[i, bit // 64] |= np.uint64(1 << (63 - bit % 64))
    return masks


#: A hot group has fewer chunks than this; a pair (c, d) of chunks is c * CHUNKS + d.
CHUNKS = 1_000_000


def _routed(codes: DataFrame, n_codes: int, keys: list[tuple[int, ...]], max_group: int) -> DataFrame:
    """``codes`` (node, w0, ..., others) once per key, with block, value, part and chunk.

    Groups of more than ``max_group`` codes are cut into chunks by hash and dealt out as
    pairs of chunks, so none goes to one task whole.
    """
    parts = [_value(n_codes, k) for k in keys]
    x = codes.select("*", F.posexplode(F.array(*parts)).alias("block", "value"))
    sizes = codes.select(F.posexplode(F.array(*parts)).alias("block", "value")).groupBy("block", "value").count()
    hot = checkpoint(sizes.where(F.col("count") > max_group))
    if hot.isEmpty():
        return x.withColumn("chunk", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
    hot = hot.select("block", "value", F.ceil(F.col("count") / max_group).cast("int").alias("chunks"))
    x = x.join(broadcast_up_to(hot, MAX_BROADCAST_TEXTS), ["block", "value"], "left")
    c = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1)))
    x = x.withColumn("chunk", c)
    # chunk c takes part in the pairs (c, d) for all d; a pair has one number
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda d: F.least("chunk", d.cast("long")) * CHUNKS + F.greatest("chunk", d.cast("long"))
    )
    return x.withColumn("part", F.explode(pairs)).select(*codes.columns, "block", "value", "chunk", "part")


def _dealt(x: DataFrame) -> DataFrame:
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "block", "value", "part")


def hamming_links(codes: DataFrame, max_bits: int, keys: list[tuple[int, ...]], max_group: int = MAX_GROUP) -> DataFrame:
    """Spanning links at ``max_bits`` or fewer bits among rows (node, w0, others) of distinct codes.

    Every column but w0 comes twice, as s_... and d_..., beside ``bits``. Complete for
    pairs that agree on one of ``keys``.
    """
    carried = tuple(c for c in codes.columns if c != "w0")
    x = _dealt(_routed(codes, 1, keys, max_group))
    kinds = [f"{side}_{c} {codes.schema[c].dataType.simpleString()}" for side in "sd" for c in carried]
    return x.mapInArrow(_linker(1, (max_bits,), carried), ", ".join([*kinds, "bits int"]))


# ---- operators --------------------------------------------------------------------


def near_groups(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links for every row of ``docs``.

    64-bit fingerprints of ``width``-word shingles link at ``max_bits`` or fewer differing
    bits; a component is named by the least doc_id in it. ``n_links`` counts the spanning
    links at the row's fingerprint, not all pairs. Texts without words (null, empty)
    have fingerprint zero and link like any other. Repeated rows share a component.
    Null ids are members, and name a component (null) only if it has no other id. An
    empty table gives no rows; other columns are not read.
    """
    f = checkpoint(fingerprints(docs, width))
    nodes = checkpoint(f.groupBy(F.col("w0").alias("w0")).agg(F.min("doc_id").alias("least")).select(F.col("w0").alias("node"), "w0", "least", F.col("least").isNull().alias("none")))
    links = checkpoint(hamming_links(nodes, max_bits, exact_keys(nodes.count(), max_bits)))
    # fingerprints go by their least id, so that the root of a component names it
    end = lambda s: F.struct(F.col(f"{s}_none").alias("none"), F.col(f"{s}_least").alias("least"), F.col(f"{s}_node").alias("node"))
    roots = connected_components(links.select(end("s").alias("src"), end("d").alias("dst"))).select(F.col("node.node").alias("node"), F.col("root.least").alias("component_id"), F.lit(True).alias("linked"))
    degree = links.select(F.explode(F.array("s_node", "d_node")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots, "node", "left").join(degree, "node", "left")
    named = named.select("w0", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return f.join(named, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


#: For documents by similarity: four words of fingerprint, routed by blocks of them; at
#: a similarity of 0.8, about 39 of 256 bits differ (standard deviation 6).
CODES, BLOCKS, MOST = 4, 22, 60
#: Bits by which texts at the threshold differ on average, and the share of them that may not meet.
FAR, MISS = 39, 0.03
#: Of texts' shingle sets, a task holds a pair of chunks of so many at most.
MAX_TEXTS = 2048
#: Rows up to which the table of texts in links is broadcast.
MAX_BROADCAST_TEXTS = 1_000_000


def _shingle_sets(width: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def similar_texts(texts: DataFrame, width: int = 5, similarity: float = 0.8, keys: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(src, dst): verified links that span the groups of near-copies among ``texts`` (text).

    Texts go by the 64-bit hash of the whole text. Candidates have 256-bit SimHash fingerprints of 60 bits
    or fewer apart that agree on one of ``keys`` (by default ``likely_keys``: 22 blocks, more
    and wider keys from 8 million texts on; two texts of similarity 0.9 meet with
    probability over 0.99, of 0.8 with 0.97). A first pass over the fingerprints marks
    the rows that have a candidate, at most one per row and block; only those get their
    shingle sets, and a second pass verifies each candidate by the Jaccard similarity
    of whole ``width``-word shingle sets, where its ends are not joined by verified links
    yet. No pair is ever written; links are spanning edges, all of them verified. Null texts and
    texts without words are left out, equal texts are one, an empty table gives no rows.
    """
    t = texts.where(F.length(F.translate("text", BLANKS, "")) > 0).select(F.xxhash64("text").alias("node"), "text")
    words = [f"w{k}" for k in range(CODES)]
    codes = checkpoint(fingerprints(t, width, CODES, ("node",)).groupBy("node").agg(*[F.first(w).alias(w) for w in words]))
    keys = keys or likely_keys(codes.count(), FAR, MISS, MAX_TEXTS)
    masks = _masks(CODES, keys)
    x = _dealt(_routed(codes, CODES, keys, MAX_TEXTS))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema)
    near = checkpoint(x.mapInArrow(_marker(CODES, MOST, masks), kinds))
    wanted = broadcast_up_to(near.select("node").distinct(), MAX_BROADCAST_TEXTS)
    sets = t.join(wanted, "node", "left_semi").mapInArrow(_shingle_sets(width), "node long, hashes binary").dropDuplicates(["node"])
    both = _dealt(near.join(sets, "node")).sortWithinPartitions("block", "value", "part")
    return checkpoint(both.mapInArrow(_verifier(CODES, MOST, masks, similarity), "src long, dst long"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, originals: DataFrame | None = None) -> DataFrame:
    """One row, all columns, of each group of near-copies: that with the least doc_id.

    Groups are the components of texts whose ``width``-word shingle sets are similar;
    equal texts are near-copies, texts without words (null, empty) of each other.
    ``originals`` (doc_id, text) may tell how documents read before lines were cut from
    them: a document whose text there is another is then also judged by that text, so
    that what a cut left of a near-copy goes with it. Ids that are null or repeated in either table
    have no original. Ties on doc_id, and null ids, which come last, go by the text's
    hash; of rows equal in both one stays. An empty table gives an empty result.
    """
    id_, node, own, original = unused(docs, "_id", "_node", "_own", "_original")
    blank = F.length(F.translate("text", BLANKS, "")) > 0
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("node"), F.xxhash64(F.when(blank, F.col("text"))).alias("own"))
    keyed = checkpoint(keyed.groupBy("id", "node", "own").agg(F.count("*").alias("n")))
    texts, more = docs.select("text"), None
    if originals is not None:
        was = originals.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("was")).groupBy("id").agg(F.min("was").alias("was"), F.count("*").alias("m")).where("m = 1")
        is_ = keyed.groupBy("id").agg(F.min("node").alias("node"), F.sum("n").alias("m")).where("m = 1")
        more = checkpoint(is_.join(was.drop("m"), "id").where("node <> was").select("id", "node", "was"))
        cut = broadcast_up_to(more.select("was").distinct(), MAX_BROADCAST_TEXTS)
        old = originals.select("text", F.xxhash64("text").alias("was")).join(cut, "was", "left_semi")
        texts = texts.unionByName(old.select("text"))
    links = similar_texts(texts, width, similarity)
    if more is not None:  # a cut document is one with its original
        links = links.unionByName(more.select(F.col("node").alias("src"), F.col("was").alias("dst")))
    roots = connected_components(links).select("node", "root")
    grouped = keyed.join(roots, "node", "left").withColumn("root", F.when(F.col("own") == F.xxhash64(F.lit(None).cast("string")), F.col("own")).otherwise(F.coalesce("root", "own")))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("node").alias("c"))
    first = grouped.groupBy("root").agg(F.min(order).alias("best"))
    gone = grouped.join(first, "root").where(order != F.col("best")).select(F.col("id").alias(id_), F.col("node").alias(own))
    gone = broadcast_up_to(checkpoint(gone), MAX_BROADCAST_TEXTS)
    named = docs.withColumns({node: F.xxhash64("text"), original: F.col("doc_id")})
    kept = named.join(gone, F.col(original).eqNullSafe(F.col(id_)) & (F.col(node) == F.col(own)), "left_anti").drop(original)
    if not keyed.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", node])
    return kept.drop(node)
