"""Cross-entropy difference of two n-gram models over one vocabulary.

The target model counts the documents named as its own, the background model all documents. Every word bigram of the corpus is
counted in tables that grow with it and stay on the executors; each block of documents gets the counts of its own
n-grams back.

The models are matched: they share vocabulary and smoothing, and the background's counts are scaled to as many words as the
target has, so that neither is smoothed harder for its size. No document is scored with its own counts: they are
taken off both models first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from ._words import U, buffers, mix, slices, words

#: Weight of the word's share in a bigram's estimate, in counts.
PRIOR = 5.0


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 2_000_000) -> DataFrame:
    """``docs`` as (id, text, is_target): those that any label row marks with 1.

    The marked ids are broadcast where they are ``most`` at most (16 MB), and joined by a shuffle beyond.
    """
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).filter("id is not null").distinct().withColumn("is_target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(good) if good.count() <= most else good, "id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


#: Bytes of text of a block of documents, which is counted and scored at once.
BLOCK_BYTES = 6 << 20
_START = U(0x5851F42D4C957F2D)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of all of them."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpack(x: pa.Scalar, kind: type) -> np.ndarray:
    b, size = memoryview(x.as_buffer()), np.dtype(kind).itemsize
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(pa.decompress(b[8:], n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _ngrams(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's (first word of each row and their number, distinct n-grams, their order, each word's places there).

    N-grams are the numbers of all words, of their histories and of their bigrams; those of words alone are odd.
    """
    _, _, h, first = words(_unpack(t["text"][0], np.uint8), _unpack(t["offs"][0], np.int64))
    u, w = np.unique(h, return_inverse=True)
    before = np.append(u, _START)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first[:-1][np.diff(first) > 0]] = len(u)
    pairs, g = np.unique(mix(before[v] * U(0xD6E8FEB86659FD93) + h, 6) & ~U(1), return_inverse=True)
    keys = np.concatenate([mix(u, 4) | U(1), mix(before, 5) & ~U(1), pairs])
    return first, keys, np.argsort(keys), [w, v + len(u), g + 2 * len(u) + 1]


def differences(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """``(id, n_words, loss_target, loss_background, score)`` for every row of ``docs`` (id, text, is_target).

    Losses are means a word under p(word | previous) = (count of both + ``PRIOR`` p(word)) / (count of previous
    + ``PRIOR``), p(word) = (count + 0.5) / (words + 0.5 (distinct words of all documents + 1)). Counts are exact and of
    the whole corpus, less those of the row that is scored, which the target loses if the row is its own; the
    background's counts and words are multiplied by the target's words over its own. ``score`` is the target's loss
    less the background's: the lower, the closer to the target; where no row is a target all scores are 0.

    Documents are written once as blocks. A block sends its distinct n-grams with their counts to the ranges they
    belong to, where they are added over all blocks, and gets back the sums of those it asked for, so a
    frequent n-gram is one entry a block and no key fills a task.

    A null or empty text has no words and scores 0; texts of any length are read whole; null ids stay, repeated rows give
    repeated rows and count each; a null ``is_target`` is none; an empty table gives an empty one; further columns are not read.
    """
    most = block_bytes or BLOCK_BYTES
    kind = docs.schema["id"].dataType.simpleString()

    def deal(batches):
        from pyspark import TaskContext

        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def whole():
            t = pa.Table.from_batches(held).combine_chunks()
            b, offs = buffers(t["text"])
            ids = t["id"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
            goal = t["is_target"].to_numpy().astype(np.uint8)
            blobs = [pa.array([_pack(x)], pa.binary()) for x in (b, offs, goal)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), *blobs], ["block", "ids", "text", "offs", "goal"])

        for b in batches:
            _, offs = buffers(b.column(1))
            for i, j in slices(offs, most):
                held.append(b.slice(i, j - i))
                size += int(offs[j] - offs[i])
                if size >= most // 2:
                    yield whole()
                    held, size, block = [], 0, block + 1
        if held:
            yield whole()

    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_target", F.lit(False)).alias("is_target"))
    scratch = Scratch()
    dealt = scratch.table(docs.mapInArrow(deal, f"block long, ids array<{kind}>, text binary, offs binary, goal binary"))
    bits = max(5, (dealt.count() // 4).bit_length())
    edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits)
    asks = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("k", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
    sums = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])

    def count(t: pa.Table) -> pa.Table:
        first, keys, order, places = _ngrams(t)
        mine = np.repeat(_unpack(t["goal"][0], np.uint8).astype(bool), np.diff(first))
        a = sum(np.bincount(x[mine], minlength=len(keys)) for x in places)[order].astype(np.int32)
        b = sum(np.bincount(x, minlength=len(keys)) for x in places)[order].astype(np.int32)
        keys, block = keys[order], t["block"][0].as_py()
        cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        out = [(r, block, _pack(np.diff(keys[i:j], prepend=U(0))), _pack(a[i:j]), _pack(b[i:j])) for r, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=asks)

    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x, U), dtype=U) for x in t["k"]]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        a, b = (np.bincount(at, np.concatenate([_unpack(x, np.int32) for x in t[c]]), len(u)).astype(np.int64) for c in "ab")
        cut = np.cumsum([0, *map(len, keys)])
        r, word = t["r"][0].as_py(), (u & U(1)).astype(bool)
        out = [(r, k, _pack(a[at[i:j]]), _pack(b[at[i:j]]), 0, 0, 0) for k, i, j in zip(t["block"].to_pylist(), cut[:-1], cut[1:], strict=True)]
        out.append((r, -1, b"", b"", int(word.sum()), int(a[word].sum()), int(b[word].sum())))
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=sums)

    def ask(batches):
        """A row is a block, so blocks are counted where they lie."""
        for b in batches:
            for i in range(b.num_rows):
                yield from count(pa.Table.from_batches([b.slice(i, 1)])).to_batches()

    asked = dealt.drop("ids").mapInArrow(ask, "r int, block long, k binary, a binary, b binary")
    told = scratch.table(asked.groupBy("r").applyInArrow(add, "r int, block long, a binary, b binary, n long, na long, nb long"))
    distinct, *totals = (x or 0 for x in told.filter("block = -1").agg(F.sum("n"), F.sum("na"), F.sum("nb")).first())

    # the background's words become as many as the target's
    matched = (1.0, totals[0] / totals[1] if totals[1] else 0.0)

    def lose(t: pa.Table, told: pa.Table) -> pa.Table:
        first, keys, order, places = _ngrams(t)
        told = told.sort_by("r")
        n, loss = np.diff(first), []
        row = np.repeat(np.arange(len(n)), n)
        goal = _unpack(t["goal"][0], np.uint8).astype(bool)[row]
        own = [_repeats(row, p, len(keys)) for p in places]
        for c, total, scale, mine in zip("ab", totals, matched, (goal, True), strict=True):
            x = np.empty(len(keys), np.int64)
            x[order] = np.concatenate([_unpack(y, np.int64) for y in told[c]])
            w, v, g = (scale * (x[p] - o * mine) for p, o in zip(places, own, strict=True))
            p = (w + 0.5) / (scale * (total - n[row] * mine) + 0.5 * (distinct + 1))
            loss.append(np.bincount(row, np.log(v + PRIOR) - np.log(g + PRIOR * p), len(n)) / np.maximum(n, 1))
        ids = t["ids"].combine_chunks()
        ids = (ids if isinstance(ids, pa.Array) else ids.chunk(0)).flatten()
        return pa.table([ids, pa.array(n.astype(np.int64)), *map(pa.array, loss), pa.array(loss[0] - loss[1])], names=["id", "n_words", "loss_target", "loss_background", "score"])

    per = told.filter("block >= 0").select("block", "r", "a", "b").groupBy("block")
    out = dealt.groupBy("block").cogroup(per).applyInArrow(lose, f"id {kind}, n_words long, loss_target double, loss_background double, score double")
    with scratch:
        return scratch.result(out)


def _repeats(row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often each word's n-gram comes in its own row."""
    _, at, count = np.unique(row * n + place, return_inverse=True, return_counts=True)
    return count[at]
