"""Toxicity by a factorization machine over hashed terms.

Terms are lower-case words and two of their prefixes, hashed into ``BUCKETS`` numbers. A term counts once a
document. Those associated with the label in the training sample, alone or in a pair, enter the machine, whose factors give
each pair of terms a weight of its own, so that an insult beside a group's name weighs more than
both alone.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import U, buffers, slices, words

BUCKETS = 1 << 20
PREFIXES = (5, 8)
#: All ASCII but letters and digits separates terms; other characters belong to them.
TERM_SEP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def terms(texts: pa.Array):
    """Distinct ``(row, bucket)`` of all texts, ascending, in slices: yields (first row, last row, rows, buckets)."""
    low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    b, offs = buffers(low)
    for i, j in slices(offs):
        part, o = b[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        _, _, h, rows, *more = words(part, o, TERM_SEP, PREFIXES)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(rows))
        yield i, j, row, [(x & U(BUCKETS - 1)).astype(np.int64) for x in (h, *more)]


def _distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


@dataclass
class Machine:
    """``index`` maps a bucket to a row of ``w`` and ``v``, or to -1."""

    index: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def margins(self, n: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Scores on the logit's scale of n rows, from their distinct terms."""
        f = self.index[bucket]
        row, f = row[f >= 0], f[f >= 0]
        out = np.bincount(row, self.w[f], n) + self.bias
        for k in range(self.v.shape[1]):
            v = self.v[f, k]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def _likelihood(k: np.ndarray, m: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of k of m documents against a share of ``base``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = k / m
        return 2 * (np.where(k > 0, k * np.log(q / base), 0) + np.where(m > k, (m - k) * np.log((1 - q) / (1 - base)), 0))


def _paired(docs: list[np.ndarray], y: np.ndarray, least: int, chance: float = 0.05) -> np.ndarray:
    """Buckets of all pairs whose documents differ in the label's share from those of either member.

    The share of a pair's documents is tested against the greater, or the lesser, of both members' and of all, by the
    likelihood ratio at ``chance`` over all pairs (Bonferroni). Buckets in too few documents of a label
    for any pair of theirs to pass are left out first, which loses none.
    """
    p = y.mean()
    df, tox, sign = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, U)
    marks = np.random.default_rng(1).integers(0, 1 << 63, len(docs), dtype=np.int64).view(U)
    for d, t, mark in zip(docs, y, marks, strict=True):
        df[d] += 1
        tox[d] += t
        sign[d] += mark
    n = float(np.count_nonzero(df >= least))
    g = 2 * np.log(max(n * n, 2) / chance)  # the chi-square's tail is below exp(-g / 2)
    rates = tox / np.maximum(df, 1)
    passed = np.zeros(BUCKETS, bool)
    for want, share in ((1.0, p), (0.0, 1 - p)):
        one = tox if want else df - tox
        ids = np.flatnonzero((df >= least) & (one * 2 * np.log(1 / share) >= g))
        # a word and its prefixes often stand in the same documents, and are then looked at once
        _, first, alike = np.unique(sign[ids], return_index=True, return_inverse=True)
        every, ids = ids, ids[first]
        if len(ids) < 2:
            continue
        place = np.full(BUCKETS, -1, np.int32)
        place[ids] = np.arange(len(ids))
        x = np.zeros((len(docs), len(ids)), np.uint8)
        for i, d in enumerate(docs):
            x[i, (k := place[d])[k >= 0]] = 1
        hit = y == want
        r = rates[ids] if want else 1 - rates[ids]
        other = np.flatnonzero(~hit)
        other = other[np.argsort([-len(docs[d]) for d in other], kind="stable")]
        good = np.zeros(len(ids), bool)
        for i in range(0, len(ids), 256):
            k = np.zeros((min(256, len(ids) - i), len(ids) - i), np.float32)
            for j in range(0, len(docs), 1000):
                c = x[j : j + 1000][hit[j : j + 1000], i:].astype(np.float32)
                k += c[:, :256].T @ c
            base = np.clip(np.maximum(np.maximum(r[i : i + 256, None], r[None, i:]), share), 1e-6, 1 - 1e-6).astype(np.float32)
            able = -2 * k * np.log(base) >= g  # with no document of the other label
            at, to = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
            m, j, step = k[np.ix_(at, to)], 0, 256
            # documents of the other label, longest first: most pairs can no longer pass after a few of them
            while len(at) and j < len(other):
                c = x[other[j : j + step], i:]
                m += c[:, at].astype(np.float32).T @ c[:, to].astype(np.float32)
                j, step = j + step, min(2 * step, 1024)
                able = (_likelihood(k[np.ix_(at, to)], m, base[np.ix_(at, to)]) >= g) & (m * base[np.ix_(at, to)] < k[np.ix_(at, to)])
                row, col = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
                m, at, to = m[np.ix_(row, col)], at[row], to[col]
            if not len(at):
                continue
            k, base = k[np.ix_(at, to)], base[np.ix_(at, to)]
            a, b = np.nonzero((m * base < k) & (m >= least) & (_likelihood(k, m, base) >= g))
            good[i + at[a]] = good[i + to[b]] = True
        passed[every[good[alike]]] = True
    return np.flatnonzero(passed)


def fit_machine(docs: list[np.ndarray], y: np.ndarray, factors: int = 8, epochs: int = 40, rate: float = 0.05, least: int = 6, z: float = 3.5, decay: float = 2e-3, seed: int = 5) -> Machine:
    """Choose terms by the z score of their log odds or by pairs, then fit by Adagrad on the logistic loss.

    ``docs`` holds the distinct buckets of each labelled document. A term needs ``least`` documents and a
    z score of ``z``, or a pair that says more than its members alone. Without both labels the machine knows nothing and always gives the share of 1.
    """
    n1, n0 = float(y.sum()), float((1 - y).sum())
    index = np.full(BUCKETS, -1, np.int32)
    if not len(docs):
        return Machine(index, np.zeros(1), np.zeros((1, factors)), -30.0)
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return Machine(index, np.zeros(1), np.zeros((1, factors)), float(np.log(p / (1 - p))))
    a, b = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for d, t in zip(docs, y, strict=True):
        (a if t else b)[d] += 1
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    var = 1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5)
    alone = np.flatnonzero((a + b >= least) & (np.abs(odds) / np.sqrt(var) >= z))
    keep = np.union1d(alone, _paired(docs, y, least))
    index[keep] = np.arange(len(keep))
    known = [(f := index[d])[f >= 0] for d in docs]
    f = np.concatenate(known)
    starts = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    r = np.random.default_rng(seed)
    w, v, bias = np.zeros(max(1, len(keep))), r.normal(0, 0.05, (max(1, len(keep)), factors)), float(np.log(n1 / n0))
    gw, gv, gb = np.full_like(w, 1e-2), np.full_like(v, 1e-2), 1e-2
    for _ in range(epochs):
        order = r.permutation(len(docs))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in part])
            d, g = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part]), f[at]
            own = v[g]
            vs, sq = (np.stack([np.bincount(d, c, len(part)) for c in x.T], 1) for x in (own, own**2))
            m = np.bincount(d, w[g], len(part)) + bias + 0.5 * (vs**2 - sq).sum(1)
            e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / len(part)
            dw = np.bincount(g, e[d], len(w))
            dv = np.stack([np.bincount(g, c, len(w)) for c in (e[d][:, None] * (vs[d] - own)).T], 1)
            dw, dv, db = dw + decay * w / 16, dv + decay * v / 4, e.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, bias = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), bias - rate * db / gb**0.5
    return Machine(index, w, v, float(bias))


def held_out(id_col: F.Column, folds: int = 5) -> F.Column:
    """Rows whose labels are never learned: crc32 of the id as text has remainder 0. A null id is none."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000) -> Machine:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold.

    They are those of the least hash of their id. Several labels of one document count as 1 if any is; null
    labels and ids are skipped, rows of one id all count, up to twice ``sample_rows`` of them. Null and empty texts
    have no terms; without any labelled document the machine always gives 0. The fit runs in one task over that bounded
    sample; the driver gets the machine alone.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    lab = lab.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = rows.join(F.broadcast(lab), "id").select("text", "y")

    def run(batches):
        for b in batches:
            y = b.column(1)
            for i, j, row, hs in terms(b.column(0)):
                r, k = _distinct(np.concatenate([row] * len(hs)), np.concatenate(hs))
                at = np.searchsorted(r, np.arange(j - i + 1))
                out = [k[at[x] : at[x + 1]].astype(np.int32).tobytes() for x in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), y.slice(i, j - i)], ["x", "y"])

    def fit(batches):
        xs, ys = [], []
        for b in batches:
            xs += [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(0)]
            ys += b.column(1).to_pylist()
        m = fit_machine(xs, (np.array(ys, float) > 0).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], ["machine"])

    sample = got.mapInArrow(run, "x binary, y int").orderBy(F.xxhash64("x"), "x", "y").limit(2 * sample_rows)
    one = sample.coalesce(1).mapInArrow(fit, "machine binary").first()
    return pickle.loads(one.machine) if one else fit_machine([], np.zeros(0))


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row, from its whole text alone.

    A null or empty text has no terms and gets the machine's bias; a very long one is read in slices and scored
    as a whole. Null ids stay, repeated rows give repeated rows, an empty table an empty one; further columns of
    ``df`` are not read. Equal texts get equal scores.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(machine, 1, [0], ["id", "score"]), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_clean(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``df`` whose text scores below ``threshold``, all columns as they are.

    Each row is judged by its whole text alone, of any length: null ids and repeated rows are kept or dropped as
    their texts are, a null or empty text by the machine's bias. An empty table gives an empty one.
    """
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for i, j, p in _scores(b.column(at), machine):
                yield b.slice(i, j - i).filter(pa.array(p < threshold))

    return df.mapInArrow(run, df.schema)


def _scores(texts: pa.Array, machine: Machine):
    for i, j, row, hs in terms(texts):
        row = np.concatenate([row[machine.index[x] >= 0] for x in hs])
        known = np.concatenate([x[machine.index[x] >= 0] for x in hs])
        m = machine.margins(j - i, *_distinct(row, known))
        yield i, j, 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _scorer(machine: Machine, at: int, keep: list[int], names: list[str]):
    def run(batches):
        for b in batches:
            for i, j, p in _scores(b.column(at), machine):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), pa.array(p)], names)

    return run
