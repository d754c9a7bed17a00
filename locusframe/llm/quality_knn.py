"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its hashed byte pairs, plus a few shares (repeated three-word
windows, repeated lines, symbols) cut into steps. Term weights (square-root frequencies
times inverse document frequency) of a bounded sample of labelled texts are reduced by
a randomised SVD; the sample's unit vectors and labels are broadcast, and every text is
compared with all of them in blocked matrix products, which are exact cosines. The
nearest neighbours' labels are weighted by similarity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The documented bound of the training sample: labelled rows with the least hashes.
SAMPLE = 3000
HASHED, STEPS = 4096, 16
TERMS = HASHED + 4 * STEPS
RANK, NEIGHBOURS, POWER, PRIOR = 48, 25, 8.0, 0.02
_SYMBOL = re.compile(rb"[#*$%&|<>]+")
_PAIR = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64) % HASHED


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term, weight) of a whole text; none for null or empty ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    b = np.frombuffer(data, np.uint8).astype(np.uint16)
    pairs = (b[:-1] << np.uint16(8)) | b[1:]
    counts = np.bincount(_PAIR[pairs], minlength=HASHED)
    t = np.flatnonzero(counts)
    w = np.sqrt(counts[t] / max(1, len(pairs)))
    words = data.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = (
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, sum(map(len, _SYMBOL.findall(data))) / (1 + n)),
        min(1.0, np.log2(1 + n) / 16),
    )
    at = [min(STEPS - 1, int(s * STEPS + (0.999 if k < 3 else 0))) for k, s in enumerate(share)]
    extra = np.array([HASHED + k * STEPS + a for k, a in enumerate(at)])
    return np.concatenate([t, extra]), np.concatenate([w, [0.5, 0.5, 0.5, 0.15]]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """What is broadcast: SAMPLE x RANK vectors, TERMS x RANK projection, labels."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, x in enumerate(texts):
            t, w = terms(x)
            if len(t):
                out[i] = w @ self.project[t]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Votes for label 1 among the nearest neighbours; without any, the prior."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        v = self.latent(texts)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(v), 256):
            cos = v[i : i + 256] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(cos, near, 1), 0, None).astype(np.float64) ** POWER
            out[i : i + 256] = ((w * self.labels[near]).sum(1) + PRIOR * self.prior) / (w.sum(1) + PRIOR)
        return out


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK) -> Model:
    """A model of a sample. Both labels weigh the same in the prior's place: their share."""
    n = len(features)
    prior = float(labels.mean()) if n else 0.5
    rng = np.random.default_rng(7)
    x = np.zeros((n, TERMS), np.float32)
    for i, (t, w) in enumerate(features):
        x[i, t] = w
    idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    r = min(rank, max(1, n))
    if not n:
        return Model(np.zeros((TERMS, r), np.float32), np.zeros((0, r), np.float32), labels, prior)
    q = x.T @ (x @ rng.standard_normal((TERMS, r + 8)).astype(np.float32))
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u = np.linalg.svd(x @ q, full_matrices=False)[2]
    project = (q @ u.T)[:, :r] * idf[:, None]
    vectors = np.zeros((n, r), np.float32)
    for i, (t, w) in enumerate(features):
        vectors[i] = w @ project[t] if len(t) else 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(project.astype(np.float32), vectors, labels.astype(np.float64), prior)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _featured(batches):
    for b in batches:
        got = [terms(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("quality"), pa.array([t.astype(np.int32).tobytes() for t, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())],
            names=["doc_id", "quality", "t", "w"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the ``sample`` labelled ids with the least hashes that are not held out.

    The labels are reduced first, so the texts are joined with ``sample`` rows; only the
    sample's terms reach the driver. Null labels and ids are left out, of an id's
    several labels the least counts. Without labels the model gives 0.5.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    lab = lab.where(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.min("quality").alias("quality"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text")
    rows = rows.mapInArrow(_featured, f"doc_id {kind}, quality int, t binary, w binary").collect()
    once = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["t"]), bytes(r["w"])))}  # of repeated ids one text
    rows = [once[k] for k in sorted(once)]
    feats = [(np.frombuffer(r["t"], np.int32).astype(np.int64), np.frombuffer(r["w"], np.float32)) for r in rows]
    return fit(feats, np.array([r["quality"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score is the similarity-weighted share of label 1 among the nearest
    neighbours; null and empty texts have no similarity to anything and get the
    sample's share of label 1. Repeated rows score alike, null ids are kept (not held
    out), an empty table gives no rows, and no column but the text enters a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and TERMS

    def run(batches):
        m = sent.value
        for b in batches:
            s = m.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "held_out")), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
