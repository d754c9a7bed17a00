"""The training-data operators against brute force on small inputs."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from locusframe.llm import chat, common, decontam, licenses, lines, mixing, quality_knn, rules, simhash, suffix, urls
from locusframe.llm import queries as q
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, _text string, _id int, _name int, _bad_id int, _ int, _node string, ID_ int, n_removed_lines int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None, sources=None):
    """Documents with further columns whose names clash with the operators' own."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(n)] if sources is None else sources
    rows = [(ids[i], t, None, sources[i], None if t is None else len(t), i, "x", "y", i, i, i, i, "z", i, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed, n=60):
    """Texts with shared passages, copies, near-copies, empty and null ones, very long ones."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [line(r.randint(15, 60)) for _ in range(4)] + ["\n".join(line(6) for _ in range(5))]
    out = [None, "", " \n\t", "a", "zz" * 400, "ab\n" * 150]
    while len(out) < n:
        kind = r.random()
        if kind < 0.2 and len(out) > 8:
            out.append(r.choice(out[6:]))
        elif kind < 0.4 and len(out) > 8:
            w = (r.choice(out[6:]) or "a").split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        else:
            parts = [line(r.randint(1, 40)) for _ in range(r.randint(1, 6))]
            if r.random() < 0.5:
                parts.insert(r.randint(0, len(parts)), r.choice(shared))
            out.append("\n".join(parts))
    out.append("\n".join(line(30) for _ in range(300)))
    return out


# ---- 1 chat formatting


def test_chat_round_trip_with_hostile_texts(spark):
    hostile = [q.HOSTILE, "\\", "\\\\n", "<turn>", "</turn>\n<turn>assistant\nx", "<\\turn", "###", "##\\#", "", None, "é😀\n", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "user\n</turn>", t) for i, t in enumerate(hostile)] + [(None, 0, None, "n"), (2, None, "assistant", None), (2, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(got[1].formatted) == [(r, t or "") for _, _, r, t in rows[: len(hostile)]]
    loss = [chat.unescape(got[1].formatted[a:z]) for a, z in got[1].spans]
    assert loss == [t or "" for i, t in enumerate(hostile) if i % 2]
    assert (got[2].n_turns, got[None].n_turns) == (2, 1)
    dig = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(hostile)]).encode()).hexdigest()
    assert dig[1].turns_sha256 == want and dig[1].loss_chars == len("".join(loss))
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_escaped_texts_hold_no_control_string():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(["#", "<", "turn", "/", "\\", "n", "</turn>", "\n", "a"]) for _ in range(r.randint(0, 12)))
        for f in (chat.escape, chat.escape_line):
            assert chat.unescape(f(t)) == t and not any(c in f(t) for c in chat.CONTROL)


def test_template_language():
    f = chat.compile_template("{% for t in turns %}{% if loop.first and not loop.last %}[{% elif t.x == 'b' %}b{% else %}{{ 'q' + t.x | upper }}{% endif %}{% endfor %}{{ 1 + 2 }}")
    assert f({"turns": [{"x": "a"}, {"x": "b"}, {"x": "c"}]}) == ("[bqC3", [])
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if true %}e{% endif %}"))
    assert tree == (chat.Emit(chat.Const("abcde")),)
    assert chat.compile_template("{{ x.__class__ }}{{ y }}")({"x": "s"}) == ("", [])
    assert chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}b")({"x": "é😀"}) == ("aé😀b", [(1, 3)])
    assert chat.compile_template("{{ 'a}}b' }}{% if x == '%}' %}1{% endif %}")({"x": "%}"}) == ("a}}b1", [])
    for bad in ("{{ x", "a {% if", "{% if a %}{% else %}{% elif b %}{% endif %}", "{% if a %}{% else %}{% else %}{% endif %}", "{% if x %}", "{{ x() }}", "{{ x | nope }}", "{% include 'x' %}", "{{ x[0] }}", "{{ }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


# ---- 2 SimHash


def brute_print(text, width=4):
    w = re.findall(WORD, (text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_groups(spark):
    texts = corpus(1, 120)
    ids = [(i * 37) % 1000 - 100 for i in range(len(texts))]
    got = {r.doc_id: r for r in simhash.near_groups(docs(spark, texts, ids)).collect()}
    prints = [brute_print(t) for t in texts]
    comp = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min(i for i, k in zip(ids, comp, strict=True) if k == c) for c in set(comp)}
    assert len(got) == len(texts)
    for i, p, c in zip(ids, prints, comp, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", least[c])


def test_simhash_null_and_repeated_rows(spark):
    rows = simhash.near_groups(docs(spark, ["a b c d e", "a b c d e", None, "", "q r s t u"], [None, 5, 7, 7, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.component_id is not None) == [(False, 5), (False, 7), (False, 7), (True, 5)]
    assert len(rows) == 5 and simhash.near_groups(docs(spark, ["a"]).limit(0)).count() == 0


def test_hamming_links_in_chunks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 5)
    codes = np.unique(base[rng.integers(0, 5, 400)] ^ (1 << rng.integers(0, 20, 400)) ^ (1 << rng.integers(0, 62, 400)) ^ (1 << rng.integers(0, 62, 400))).tolist()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "node long, w0 long")
    want = brute_components(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    for most, keys in ((8192, simhash.exact_keys(len(codes), 4)), (20, simhash.exact_keys(len(codes), 4)), (8192, simhash.exact_keys(10**10, 4)), (8192, simhash.exact_keys(10**15, 4))):
        links = simhash.hamming_links(df, 4, keys, most).select(F.col("s_node").alias("src"), F.col("d_node").alias("dst"))
        roots = {r.node: r.root for r in common.connected_components(links).collect()}
        assert [roots.get(i, i) for i in range(len(codes))] == want


def test_keys_grow_with_the_corpus():
    assert [len(simhash.exact_keys(n, 4)) for n in (10, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 15, 35, 70]
    r = random.Random(1)
    for n in (10, 10**8, 10**10, 10**12):
        keys = simhash.exact_keys(n, 4)
        masks = [int(m[0]) for m in simhash._masks(1, keys)]
        for _ in range(200):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_near_duplicates_one_stays(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [[r.choice(vocab) for _ in range(r.randint(60, 400))] for _ in range(25)]
    texts, group = [], []
    for g, b in enumerate(base):
        for _ in range(r.randint(1, 6)):
            w = list(b)
            w[r.randrange(len(w))] = "other"
            texts.append(" ".join(w))
            group.append(g)
    texts += ["", None, " ", texts[0]]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    comp = brute_components(sets, lambda a, b: (not a and not b) or len(a & b) / max(1, len(a | b)) >= 0.8)
    kept = [x.doc_id for x in simhash.drop_near_duplicates(docs(spark, texts)).collect()]
    assert sorted(kept) == sorted({c: min(i for i, k in enumerate(comp) if k == c) for c in set(comp)}.values())
    twice = simhash.drop_near_duplicates(docs(spark, ["a b", "a b", "c", None], [1, 1, None, None]))
    assert sorted((x.doc_id or 0, x.text or "") for x in twice.collect()) == [(0, ""), (0, "c"), (1, "a b")]
    assert twice.columns == docs(spark, ["a"]).columns and simhash.drop_near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_near_duplicates_families_astride_the_threshold(spark, monkeypatch):
    r = random.Random(11)
    texts = []
    for _ in range(6):  # pairs of a family are now above, now below a similarity of 0.8
        base = [f"w{r.randrange(3000)}" for _ in range(300)]
        for i in range(25):
            w = list(base)
            for k in r.sample(range(300), r.randint(2, 11)):
                w[k] = f"v{i}"
            texts.append(" ".join(w))
    # equal fingerprints, as one shingle outweighs the rest, of texts that are not near-copies
    for a in "ab":
        for z in "xy":
            texts.append("same " * 400 + " ".join(f"{a}{i}" for i in range(40)) + f" {z}")
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    sets = [set(h.tolist()) for h in hashes]
    prints = [sum(simhash.fingerprint(simhash._mix(h, k)) << (64 * (simhash.CODES - 1 - k)) for k in range(simhash.CODES)) for h in hashes]
    edges = np.linspace(0, 64 * simhash.CODES, simhash.BLOCKS + 1).round().astype(int).tolist()

    def near(i, j):
        x = format(prints[i] ^ prints[j], f"0{64 * simhash.CODES}b")
        met = x.count("1") <= simhash.MOST and any("1" not in x[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True))
        return met and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8

    comp = brute_components(list(range(len(texts))), near)
    for most in (simhash.MAX_TEXTS, 10):  # groups whole, and in pairs of chunks
        monkeypatch.setattr(simhash, "MAX_TEXTS", most)
        kept = [x.doc_id for x in simhash.drop_near_duplicates(docs(spark, texts)).collect()]
        assert sorted(kept) == sorted({c: min(i for i, k in enumerate(comp) if k == c) for c in set(comp)}.values())


def test_recall_at_the_threshold(spark):
    r = random.Random(17)
    pairs = []
    while len(pairs) < 400:  # texts of any length, at a similarity of 0.8 to 0.85
        n = r.randint(60, 400)
        a = [f"w{r.randrange(5000)}" for _ in range(n)]
        b = list(a)
        for k in r.sample(range(n), max(1, n // 45)):
            b[k] = f"v{r.randrange(5000)}"
        x, y = (set(simhash.shingle_hashes(" ".join(w), 5).tolist()) for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            pairs.append((" ".join(a), " ".join(b)))
    kept = simhash.drop_near_duplicates(docs(spark, [t for p in pairs for t in p])).select("doc_id").collect()
    assert 2 * len(pairs) - len(kept) >= 0.9 * len(pairs)


def test_wider_keys_of_a_large_corpus(spark):
    r = np.random.default_rng(5)
    for n in (10**6, 10**8, 10**10):
        keys = simhash.likely_keys(n, simhash.FAR, simhash.MISS, simhash.MAX_TEXTS)
        masks = simhash._masks(simhash.CODES, keys)
        bits = np.bitwise_count(masks).sum(axis=1)
        assert n >> int(bits.max()) <= simhash.MAX_TEXTS and len(set(keys)) == len(keys) and len(keys) < 500
        differ = np.zeros((4000, 64 * simhash.CODES), np.uint8)
        for x in differ:
            x[r.choice(x.size, simhash.FAR, replace=False)] = 1
        words = np.packbits(differ, axis=1).view(">u8").astype(np.uint64)
        assert np.mean([(~(w & masks).any(axis=1)).any() for w in words]) >= 0.96
    random_ = random.Random(23)
    words = lambda n: [f"w{random_.randrange(9000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        a = words(120)
        texts += [" ".join(a), " ".join(a[:119] + words(1)), " ".join(words(120))]
    wide = simhash.likely_keys(10**8, simhash.FAR, simhash.MISS, simhash.MAX_TEXTS)
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [{tuple(sorted(x)) for x in simhash.similar_texts(t, keys=k).collect()} for k in (None, wide)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_verifier_does_not_copy_shingle_sets():
    base = np.arange(10**5, dtype=np.uint64)
    sets = [(base + np.uint64(i * 10 + 10**6 * (i >= 20))).tobytes() for i in range(40)]
    n, zero = len(sets), pa.array(np.zeros(40, np.int64))
    words = {f"w{k}": zero for k in range(simhash.CODES)}
    cols = {"node": pa.array(np.arange(n)), **words, "block": pa.array(np.zeros(n, np.int32)), "value": zero, "part": zero, "chunk": zero, "hashes": pa.array(sets, pa.binary())}
    batch, was = pa.RecordBatch.from_pydict(cols), pa.default_memory_pool()
    run = simhash._verifier(simhash.CODES, simhash.MOST, simhash._masks(simhash.CODES, [(simhash.BLOCKS, i) for i in range(simhash.BLOCKS)]), 0.8)
    pool = pa.proxy_memory_pool(was)
    pa.set_memory_pool(pool)
    try:
        links = [tuple(sorted(x.values())) for b in run(iter([batch.slice(0, 7), batch.slice(7)])) for x in b.to_pylist()]
        assert pool.max_memory() < 10**6 < sum(map(len, sets))
    finally:
        pa.set_memory_pool(was)
    assert len(set(links)) == 38 and all((a < 20) == (b < 20) for a, b in links)  # two families, each spanned


def test_near_duplicates_by_their_originals(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    whole, cut = words("a", 200), words("a", 190) + " " + words("b", 10)
    was = docs(spark, [whole, cut, words("c", 50), "x y", "x z"], [1, 2, 3, 4, 4])
    now = docs(spark, [whole, words("b", 10), words("c", 50), words("d", 10), None], [1, 2, 3, 5, None])
    assert sorted(x.doc_id or 0 for x in simhash.drop_near_duplicates(now).collect()) == [0, 1, 2, 3, 5]
    assert sorted(x.doc_id or 0 for x in simhash.drop_near_duplicates(now, originals=was).collect()) == [0, 1, 3, 5]
    assert simhash.drop_near_duplicates(now.limit(0), originals=was).count() == 0
    assert simhash.drop_near_duplicates(now, originals=was.limit(0)).count() == 5


def test_components(spark):
    e = [(1, 2), (2, 3), (10, 9), (3, 1), (7, 7), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, **{100 + i: 100 for i in range(41)}}


# ---- 3 line dedup


def brute_lines(texts, min_words):
    """(removed line numbers) per text, by comparing all runs with all earlier starts."""
    seqs = []
    for t in texts:
        ls = (t or "").split("\n")
        seqs.append([(i, x, len(re.findall(WORD, x))) for i, x in enumerate(ls) if re.search(WORD, x)])
    starts = defaultdict(list)
    for d, s in enumerate(seqs):
        for k, (_, x, _) in enumerate(s):
            starts[x].append((d, k))
    out = []
    for d, s in enumerate(seqs):
        gone = set()
        for k in range(len(s)):
            for e, m in starts[s[k][1]]:
                if (e, m) < (d, k):
                    n = 0
                    while k + n < len(s) and m + n < len(seqs[e]) and s[k + n][1] == seqs[e][m + n][1]:
                        n += 1
                    if sum(x[2] for x in s[k : k + n]) >= min_words:
                        gone.update(s[j][0] for j in range(k, k + n))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts), 20).collect()}
    for i, (t, gone) in enumerate(zip(texts, brute_lines(texts, 20), strict=True)):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (got[i].n_removed_lines, got[i].text) == (len(gone), want)


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    d = docs(spark, [long, long, long + "\n" + long, None, long], [None, 3, 3, 4, 3])
    got = lines.dedup_lines(d)
    assert got.columns == d.columns and got.count() == 5
    assert sorted(r.n_removed_lines for r in got.collect()) == [0, 0, 1, 1, 2]
    assert lines.dedup_lines(d.limit(0)).count() == 0


# ---- 4 licences


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    odd = "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,").replace("\n", "\r\n  ").replace("SUBLICENSE", "Sublicence") + "\n(C) 1999 X\nAll rights reserved."
    texts = [mit, odd, mit + " extra", "Released under the MIT licence", None, "", "...", "x" * 100_000]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i].license for i in range(len(texts))] == ["MIT", "MIT", None, "MIT line", None, None, None, None]
    assert got[4].digest == got[5].digest == got[6].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(docs(spark, ["a"]).limit(0)).count() == 0


def test_licenses_wrapped_titled_and_respelt(spark):
    known = licenses.known_texts()
    wrap = lambda t, w: "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))
    cases = [
        ("ISC License\n\nCopyright 2019 A. Person\n\n" + wrap(known["ISC"], 72), "ISC"),
        ("The MIT License (MIT)\n\nCopyright © 2021 B\n\n" + wrap(known["MIT"], 50), "MIT"),
        (known["MIT"].replace("sublicense", "sub-licence").replace("Software", "SOFTWARE"), "MIT"),
        (known["Apache-2.0"].replace("License", "Licence").replace("\n", "\r\n"), "Apache-2.0"),
        (known["GPL-3.0"].upper(), "GPL-3.0"), (known["MPL-2.0"], "MPL-2.0"), (known["CC0-1.0"] + "\n\n\n", "CC0-1.0"),
        (known["MIT"].replace("NOT LIMITED", "LIMITED"), None), (known["GPL-3.0"][:-40], None),
    ]
    rows = [(None if i == 1 else 7, t) for i, (t, _) in enumerate(cases)] * 2  # null and repeated ids
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.license for r in got) == Counter([x for _, x in cases] * 2)
    words = lambda t: spark.createDataFrame([(t,)], "t string").select(licenses.canonical(F.col("t"))).first()[0]
    assert words("Fulfil, fulfill licence LICENCE") == "fulfill fulfill license license"
    assert words("copyright notice and this\n(c) You must\nCopyright (c) X\n© 2020 me\nCopyright [yyyy] [name]") == "copyright notice and this c you must"


# ---- 5 quality votes


def test_quality_votes(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_knn.score(d, quality_knn.train(d, lab)).collect()}
    assert len(got) == d.count()
    y = [(got[r.doc_id].score, r.quality) for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == z for s, z in y]) > 0.95
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for i, g in got.items())


def test_quality_votes_edges(spark):
    d = docs(spark, [None, "", "x", "a b " * 20_000], [1, None, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_knn.score(d, quality_knn.train(d, none)).collect()] == [0.5] * 4
    lab = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, quality int")
    assert len(quality_knn.score(d, quality_knn.train(d, lab)).collect()) == 4
    assert quality_knn.score(d.limit(0), quality_knn.train(d, lab)).count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(80)]
    y = rng.integers(0, 2, 60).astype(float)
    m = quality_knn.fit([quality_knn.terms(t) for t in texts[:60]], y)
    v, s = m.latent(texts), m.score(texts)
    for i in range(80):
        cos = sorted(((float(v[i] @ m.vectors[j]), y[j]) for j in range(60)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(c, 0) ** quality_knn.POWER for c, _ in cos]
        assert abs(s[i] - (sum(a * b for a, (_, b) in zip(w, cos, strict=True)) + quality_knn.PRIOR * m.prior) / (sum(w) + quality_knn.PRIOR)) < 1e-3


# ---- 6 URL filter


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://x.fr/a"), (4, None), (5, "nothing"),
        (6, "http://www.spam-farm.example.com"), (7, "https://notexample.org/es/"), (8, "a://b.com/de/1://c"), (9, "http://x.com?/fr/"), (9, "http://x.com?/fr/"),
    ]
    got = sorted(tuple(r) for r in urls.judge_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect())
    assert got == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "x.fr", "/a", None, "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "www.spam-farm.example.com", "", None, "block"), (7, "notexample.org", "/es/", "org/", "allow"),
        (8, "b.com", "/de/1://c", "com/de/", "block"), (9, "x.com", "", None, "allow"), (9, "x.com", "", None, "allow"),
    ]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    listed = spark.createDataFrame([("b.com",), (None,), ("b.com",)], "key string")
    odd = spark.createDataFrame([(None, "x://A.B.com"), (None, None), (1, "x://notb.com"), (1, "x://notb.com")], "page_id long, url string")
    assert sorted(r.verdict for r in urls.judge_urls(odd, listed).collect()) == ["allow", "allow", "allow", "block"]


def test_cascade_is_exact(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) key")
    listed = spark.range(4900, 5300).selectExpr("cast(id as string) key").union(spark.createDataFrame([(None,)], "key string"))
    c = urls.Cascade(keys, listed)
    assert len(c.levels) > 1
    assert sorted(int(r.key) for r in keys.where(c.has(keys["key"])).collect()) == list(range(4900, 5000))
    assert keys.where(urls.Cascade(keys, listed.limit(0)).has(keys["key"])).isEmpty()
    assert keys.where(urls.Cascade(keys, keys).has(keys["key"])).count() == 5000
    dealt = urls.Cascade(keys, listed, 1000)  # a list too long for one level
    assert dealt.parts and sorted(int(r.key) for r in keys.where(dealt.has(keys["key"])).collect()) == list(range(4900, 5000))


# ---- 7 decontamination


def brute_contained(texts, items, t=0.8):
    words = lambda x: [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    out = set()
    for k, item in items:
        w = words(item)
        if w:
            n = min(5, len(w))
            want = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            for d, x in enumerate(texts):
                v = words(x)
                have = want & {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
                if len(have) >= t * len(want) - 1e-9:
                    out.add((d, k, len(want), len(have)))
    return out


def test_decontamination(spark):
    r = random.Random(4)
    texts = corpus(4)
    items = []
    for k in range(40):
        w = (texts[r.randrange(6, len(texts))] or "").split()
        a = r.randrange(max(1, len(w) - 5))
        w = w[a : a + r.randint(3, 40)]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "changed"
        items.append((k, " ".join(w).upper()))
    items += [(90, None), (91, ""), (92, "...")]
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n int")
    got = {(x.doc_id, x.item_id, x.n_item, x.n_shared) for x in decontam.contained_items(docs(spark, texts), it).collect()}
    want = brute_contained(texts, items)
    assert got == want and len(want) > 20
    kept = {x.doc_id for x in decontam.drop_contaminated(docs(spark, texts), it).collect()}
    assert kept == set(range(len(texts))) - {d for d, *_ in want}
    assert decontam.contained_items(docs(spark, texts), it.limit(0)).count() == 0
    assert decontam.contained_items(docs(spark, texts).limit(0), it).count() == 0
    odd = docs(spark, [items[0][1], items[0][1], "other"], [None, None, None])
    assert decontam.drop_contaminated(odd, it.where("item_id = 0")).count() == 1


# ---- 8 suffix array


def brute_bytes(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                cut[i : i + length] = True
            seen.add(s)
        out.append((len(b), int(cut.sum()), int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~cut])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    texts = corpus(seed)
    r = random.Random(seed)
    texts += ["ab" * 5000, "q" * 9000 + "\n" + "q" * 300, "".join(r.choice("ab") for _ in range(3000)), "\x00" * 350, "é" * 130, "x" * 99, "x" * 100, "x" * 101]
    got = {x.doc_id: x for x in suffix.dedup_substrings(docs(spark, texts)).collect()}
    for i, (n, cut, runs, kept) in enumerate(brute_bytes(texts)):
        g = got[i]
        assert (g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept)) == (n, cut, runs, kept), i


def test_substring_dedup_edges(spark):
    t = "".join(chr(97 + (i * i) % 26) for i in range(400))
    rows = suffix.dedup_substrings(docs(spark, [t, t, t, None], [2, None, 2, 9])).collect()
    assert sorted((x.doc_id or 0, x.n_removed > 0) for x in rows if x.n_bytes) in ([(0, True), (2, True), (2, True)], [(0, False), (2, True), (2, True)])
    assert suffix.dedup_substrings(docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 2, 40])
def test_substring_dedup_hot_names(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    phrase = " ".join(word() for _ in range(9))  # under a window long; what surrounds it differs, or is one of three
    ends = [" ".join(word() for _ in range(6)) for _ in range(3)]
    side = lambda: r.choice(ends) if r.random() < 0.4 else " ".join(word() for _ in range(6))
    texts = [f"{side()} {phrase} {side()}" for _ in range(120)] + ["ab" * 3000, "q" * 5000, ("ab" * 3000)[1:], None, ""]
    sizes = []
    cut = suffix._sorted_copies

    def spied(length):
        run = cut(length)

        def counted(batches):
            batches = list(batches)
            h = [x for b in batches for x in b.column("h").to_pylist()]
            assert not h or max(Counter(h).values()) <= hot, "a task takes a whole hot name"
            return run(batches)

        sizes.append(length)
        return counted

    monkeypatch.setattr(suffix, "_sorted_copies", spied)
    got = {x.doc_id: x for x in suffix.dedup_substrings(docs(spark, texts)).collect()}
    for i, (n, removed, runs, kept) in enumerate(brute_bytes(texts)):
        g = got[i]
        assert (g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept)) == (n, removed, runs, kept), i
    assert sizes


def test_substring_dedup_many_rows_of_one_id(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    # every text is its own, but for a passage that each hundredth has between other words
    shared = " ".join(word() for _ in range(20))
    texts = [" ".join(word() for _ in range(15)) + (shared if i % 100 == 0 else "") for i in range(20_000)]
    rows = suffix.dedup_substrings(docs(spark, texts, [None] * len(texts))).collect()
    size = Counter(len(t) for t in texts)
    assert len(rows) == len(texts) and Counter(x.n_bytes for x in rows) == size
    # one text keeps the passage; the others lose it, and a few bytes that agree by chance
    cut = [x for x in rows if x.n_removed]
    assert len(cut) == len(texts) // 100 - 1
    assert all(x.n_bytes > 200 and len(shared) <= x.n_removed < len(shared) + 8 for x in cut)
    kept = Counter(bytes(x.kept) for x in rows if not x.n_removed)
    assert sum((kept - Counter(t.encode() for t in texts)).values()) == 0


def test_substring_dedup_compares_bytes(spark):
    # Thue-Morse sequences of blocks collide under any polynomial hash modulo 2^64
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    a, b, head = word(32), word(32), word(60)
    bits = [i.bit_count() & 1 for i in range(64)]
    texts = [head + "".join((a, b)[x] for x in bits), head + "".join((b, a)[x] for x in bits)]
    got = {x.doc_id: x for x in suffix.dedup_substrings(docs(spark, texts)).collect()}
    for i, (n, cut, runs, kept) in enumerate(brute_bytes(texts)):
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) == (n, cut, runs, kept), i


def test_suffix_array():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 250):
        for n in (1, 2, 7, 300):
            t = rng.integers(1, k + 1, n).astype(np.uint8)
            b = t.tobytes()
            assert suffix.suffix_array(t, n + 8).tolist() == sorted(range(n), key=lambda i: b[i:])


# ---- 9 mixing


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mixing(spark):
    r = random.Random(2)
    texts = [None if r.random() < 0.02 else "w " * r.randint(0, 60) for _ in range(3000)]
    sources = [r.choice([None, "a", "a", "a", "B", "é", "zz", "tiny" if i % 50 == 0 else "a"]) for i in range(3000)]
    got = mixing.mix(docs(spark, texts, None, sources)).collect()
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert x.size == len((texts[x.doc_id] or "").split()) and x.source == sources[x.doc_id] and x.taken in (0, x.size, 2 * x.size)
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    want = water(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6 and abs(taken[s] - want[s]) <= 60
    again = mixing.mix(docs(spark, texts, None, sources).repartition(7)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in got)


def test_mixing_cuts_groups_of_equal_rows(spark):
    for n, size in ((100, 10), (7, 3)):
        d = docs(spark, ["w " * size] * n + ["x y"] * 4, [1] * n + [2, 3, 4, 5], ["a"] * n + ["b"] * 4).repartition(3)
        rows = mixing.mix(d).collect()
        for s in "ab":
            assert abs(sum(r.taken for r in rows if r.source == s) - next(r.target for r in rows if r.source == s)) <= max(size, 2) / 2 + 1e-6
        again = mixing.mix(d.repartition(5)).collect()
        assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert [x.taken for x in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    assert mixing.mix(docs(spark, ["a b"] * 5, [1, 1, None, None, 2], [None] * 5)).count() == 5


# ---- 10 rules


def test_rules(spark):
    texts = corpus(7) + ["a b c d e " * 10, "x\nx\ny\n\n \n", "a#b $$", "w " * 9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w1 w2 w3 w4 w5"]
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(WORD, t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        ls = [x for x in t.split("\n") if re.search(WORD, x)]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(rep))
        assert g.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (g.base_failed and g.kept)


def test_policies_and_ablations(spark):
    led = rules.ledger(docs(spark, corpus(7)))
    rows = led.collect()
    for p in rules.POLICIES:
        mask = rules.mask_of(rules.POLICIES[p])
        ab = {r.rule: r for r in rules.ablations(led, p).collect()}
        for rule in rules.RULES:
            if rule.name in ab:
                b = 1 << rule.bit
                assert ab[rule.name].failed == sum(r.failures & b != 0 for r in rows)
                assert ab[rule.name].only_by_this == sum(r.failures & mask == b for r in rows)
                assert ab[rule.name].kept_without == sum(r.failures & mask & ~b == 0 for r in rows)
    d = docs(spark, ["good words " + " ".join(f"w{i}" for i in range(20)), None, "x"], [1, 1, None])
    kept = rules.keep_good(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [1]
    assert rules.ledger(d.limit(0)).count() == 0


def test_substring_dedup_with_hot_names(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    texts = corpus(3)
    got = {x.doc_id: x for x in suffix.dedup_substrings(docs(spark, texts)).collect()}
    for i, (n, cut, runs, kept) in enumerate(brute_bytes(texts)):
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) == (n, cut, runs, kept), i
