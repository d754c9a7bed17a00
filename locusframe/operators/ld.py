"""Linkage disequilibrium between pairs of sites."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.pairs import key_starts, site_calls, whole_keys


#: Sites of a block; all pairs of two blocks are compared at once, so a window of any size takes bounded memory.
BLOCK = 128


def _ld_block(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, d, d_prime, r, r2 and whether they count, of all sites of x with all of y (bases x sites x haplotypes, one-hot)."""
    nx, ny = x @ y.sum(0).T, x.sum(0) @ y.transpose(0, 2, 1)
    n = nx.sum(0)
    ok = ((nx > 0).sum(0) == 2) & ((ny > 0).sum(0) == 2)
    i, j = nx.argmax(0), ny.argmax(0)
    both = (x[:, None] @ y.transpose(0, 2, 1)[None]).reshape(16, *n.shape)
    take = lambda v, at: np.take_along_axis(v, at[None], 0)[0].astype(float)
    n = n.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        p, q = take(nx, i) / n, take(ny, j) / n
        d = take(both, i * 4 + j) / n - p * q
        top = np.where(d < 0, np.maximum(-p * q, -(1 - p) * (1 - q)), np.minimum(p * (1 - q), (1 - p) * q))
        spread = p * (1 - p) * q * (1 - q)
        return n, d, d / top, d / np.sqrt(spread), d * d / spread, ok


def ld_pairs(calls: DataFrame, keys: list[str], max_distance: int | None = None) -> DataFrame:
    """D, D', r and r2 of site pairs pos_a < pos_b of a window, over shared haplotypes.

    Both sites must be biallelic there; the reference allele is the most common one, the
    lower base on ties. A site's haplotypes travel as one array; a window's sites are in one
    task, which counts all pairs of two blocks of sites by matrix products.
    """
    k = [*dict.fromkeys([*keys, "scaffold"])]
    sites = site_calls(calls, k).where(F.size("h") > 0).select(*k, "position", "h", "allele")
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sites = sites.repartition(n, *k).sortWithinPartitions(*k, "position")
    types = [(f.name, f.dataType.simpleString()) for f in sites.schema.fields[: len(k)]]
    at = sites.schema["position"].dataType.simpleString()
    columns = [*types, ("pos_a", at), ("pos_b", at), ("n", "bigint"), *[(c, "double") for c in ("d", "d_prime", "r", "r2")]]

    def run(batches):
        for own, position, h, allele, ends in windows_of(batches, len(k)):
            haps, at = np.unique(h, return_inverse=True)
            x = np.zeros((4, len(position), len(haps)), np.float32)
            x[allele, np.repeat(np.arange(len(position)), np.diff(ends)), at] = 1
            for a in range(0, len(position), BLOCK):
                for b in range(a, len(position), BLOCK):
                    p, q = position[a : a + BLOCK], position[b : b + BLOCK]
                    if max_distance is not None and q[0] - p[-1] > max_distance:
                        break
                    *stats, ok = _ld_block(x[:, a : a + BLOCK], x[:, b : b + BLOCK])
                    gap = q[None] - p[:, None]
                    i, j = np.nonzero(ok & (gap > 0) & (gap <= (gap.max() if max_distance is None else max_distance)))
                    if len(i):
                        stats[0] = stats[0].astype(np.int64)
                        rest = [pa.array(v) for v in (p[i], q[j], *[v[i, j] for v in stats])]
                        yield pa.RecordBatch.from_arrays([*[pa.repeat(v, len(i)) for v in own], *rest], names=[c for c, _ in columns])

    def windows_of(batches, n_keys):
        for t in whole_keys(batches, n_keys):
            flat = [c.combine_chunks() for c in t.columns]
            position = flat[n_keys].to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(flat[n_keys + 1].value_lengths().to_numpy(zero_copy_only=False)))
            h, allele = (c.flatten().to_numpy(zero_copy_only=False) for c in flat[n_keys + 1 :])
            first = np.flatnonzero(key_starts(flat[:n_keys]))
            for a, z in zip(first.tolist(), np.append(first[1:], t.num_rows).tolist(), strict=True):
                s = slice(ends[a], ends[z])
                yield [c[a] for c in flat[:n_keys]], position[a:z], h[s], allele[s], ends[a : z + 1]

    return sites.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in columns))


def _r2(x: np.ndarray, y: np.ndarray) -> float:
    m = (x >= 0) & (y >= 0)
    a, b = x[m].astype(float), y[m].astype(float)
    return float(np.corrcoef(a, b)[0, 1] ** 2) if len(a) > 1 and a.std() > 0 and b.std() > 0 else float("nan")


def phase_for_ld(m: np.ndarray, samples: list[np.ndarray]) -> np.ndarray:
    """Alleles (sites x haplotypes, -1 missing) with each heterozygote put in the order of greatest LD.

    Sites with heterozygotes go by their number, most first (earlier on ties). The first has
    every sample's alleles ascending; each further one ascending or descending, whichever has the
    greater mean r2 with the sites done before; ascending on ties, and where r2 is not defined.
    With fewer than two such sites nothing changes.
    """
    het = np.array([sum(len(set(row[s][row[s] >= 0].tolist())) > 1 for s in samples) for row in m], int)
    todo = [i for i in sorted(range(len(m)), key=lambda i: (-het[i], i)) if het[i]]
    out = m.copy()
    if len(todo) < 2:
        return out

    def ordered(row, step):
        new = row.copy()
        for s in samples:
            new[s] = np.sort(row[s])[::step]
        return new

    mean = lambda v: np.nanmean(v) if not np.isnan(v).all() else 0.0
    out[todo[0]] = ordered(m[todo[0]], 1)
    for k, i in enumerate(todo[1:], 1):
        up, down = ordered(m[i], 1), ordered(m[i], -1)
        score = [mean(np.array([_r2(out[j], o) for j in todo[:k]])) for o in (up, down)]
        out[i] = up if score[0] >= score[1] - 1e-12 else down
    return out


def max_ld_phase(calls: DataFrame, keys: list[str], types: str) -> DataFrame:
    """Per window (keys) position, sample, hap, allele of the sites with at most two alleles, phased by ``phase_for_ld``."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="position", columns=["sample", "hap"], values="allele", aggfunc="first", dropna=False).sort_index().sort_index(axis=1)
        m = t.to_numpy(float)
        m = np.where(np.isnan(m), -1, m).astype(int)
        ok = np.array([len(set(r[r >= 0].tolist())) <= 2 for r in m], bool)
        m, pos = m[ok], t.index.to_numpy()[ok]
        names = t.columns.get_level_values("sample").to_numpy()
        m = phase_for_ld(m, [np.flatnonzero(names == s) for s in pd.unique(names)])
        out = pd.DataFrame({"position": np.repeat(pos, m.shape[1]), "sample": np.tile(names, len(m)), "hap": np.tile(t.columns.get_level_values("hap").to_numpy(), len(m))})
        out["allele"] = pd.array(np.where(m < 0, 0, m).ravel(), dtype="Int64")
        out.loc[m.ravel() < 0, "allele"] = pd.NA
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    names = [*keys, "position", "sample", "hap", "allele"]
    return calls.select(*names).groupBy(*keys).applyInPandas(kernel, f"{types}, position long, sample long, hap long, allele long")
