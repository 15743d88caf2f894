"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the n-grams of an item that are rarest by the corpus's counts of their words: of each
``SPREAD`` neighbours the rarest, so that every stretch of ``SEED + SPREAD - 1`` words that edits have spared holds one. Documents are streamed
against the seeds; where one occurs, the passage around it is aligned with the item word by word, which
scores edited and paraphrased copies as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import U, buffers, grams, slices, words
from .toxicity import TERM_SEP

SEED, SPREAD = 3, 2
MATCH, MISS, GAP = 2, -1, -1
#: Items, and characters of items, whose seeds travel together; more take more passes.
ITEMS, ITEM_CHARS = 20_000, 16 << 20
#: Cells of the rows of the matrices that are filled at once.
CELLS = 1 << 20
_BITS = 22


def _terms(texts: pa.Array):
    low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    b, offs = buffers(low)
    for i, j in slices(offs):
        _, _, h, rows = words(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i], TERM_SEP)
        yield i, j, h, rows


def align(region: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, end in region, end in item) of local alignments of rows; 0 pads regions, items end with 1.

    A row of the matrix at a time for all alignments: gaps along the region are a running maximum.
    """
    n, r = region.shape
    prev, step = np.zeros((n, r + 1), np.int32), np.arange(r + 1, dtype=np.int32) * -GAP
    best, at, row = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        cur = np.zeros((n, r + 1), np.int32)
        diag = prev[:, :-1] + np.where(region == item[:, i : i + 1], MATCH, MISS)
        cur[:, 1:] = np.maximum(np.maximum(diag, prev[:, 1:] + GAP), 0)
        cur = np.maximum.accumulate(cur + step, 1) - step
        k = cur.argmax(1)
        top = cur[np.arange(n), k]
        better = top > best
        best[better], at[better], row[better] = top[better], k[better], i + 1
        prev = cur
    return best, at, row


@dataclass
class Seeds:
    """Seeds of one length: ascending numbers, and for each the items it comes from and its places there."""

    length: int
    seeds: np.ndarray
    firsts: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, rows: np.ndarray):
        """``(rows, item indices, where the item would start)`` of all occurrences of seeds."""
        g, firsts = grams(h, rows, self.length)
        hit = np.flatnonzero(self.bitmap[(g >> U(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.seeds, g[hit]), len(self.seeds) - 1)
        ok = self.seeds[k] == g[hit]
        hit, k = hit[ok], k[ok]
        row = np.searchsorted(firsts, hit, "right") - 1
        pos = hit - firsts[row]
        n = self.firsts[k + 1] - self.firsts[k]
        flat = np.repeat(self.firsts[k], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(row, n), self.owners[flat], np.repeat(pos, n) - self.places[flat]


@dataclass
class Matcher:
    """Items and seeds of one block of items; plain arrays that travel to the executors."""

    item_ids: np.ndarray
    codes: list
    seeds: list[Seeds]
    threshold: float

    def match(self, texts: pa.Array):
        """``(rows, item indices, scores, first words, ends)`` of all texts; one alignment a row and item."""
        found = []
        for i, _, h, rows in _terms(texts):
            got = [x for s in self.seeds for x in [s.hits(h, rows)] if len(x[0])]
            if got:
                found += [(i + r, t, *x) for r, t, *x in self._aligned(h, rows, *(np.concatenate(c) for c in zip(*got, strict=True)))]
        return found

    def _aligned(self, h, rows, row, item, start):
        """Clusters of seeds on near diagonals, each aligned once; of equal scores the earlier place counts."""
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        size = np.array([len(c) for c in self.codes])
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
        # a cluster spans two lengths of its item at most; longer ones go on as the next
        run = np.flatnonzero(new)[np.cumsum(new) - 1]
        part = (start - start[run]) // (2 * size[item])
        new[1:] |= part[1:] != part[:-1]
        first = np.flatnonzero(new)
        last = np.append(first, len(row))[1:] - 1
        row, item, lo, hi = row[first], item[first], start[first], start[last]
        pad = size[item] // 4 + 4
        lo = np.maximum(lo - pad, 0) + rows[row]
        hi = np.minimum(hi + size[item] + pad + rows[row], rows[row + 1])
        out = {}
        order = np.argsort(hi - lo, kind="stable")
        at = 0
        while at < len(order):
            # as many as fit, shortest regions first, one at least
            fit = np.arange(1, len(order) - at + 1) * np.maximum((hi - lo)[order[at:]], np.maximum.accumulate(size[item[order[at:]]]))
            part = order[at : at + max(1, int(np.searchsorted(fit, CELLS, "right")))]
            at += len(part)
            width, length = int((hi - lo)[part].max()), int(size[item[part]].max())
            region, code = np.zeros((len(part), width), U), np.ones((len(part), length), U)
            for x, p in enumerate(part):
                region[x, : hi[p] - lo[p]] = h[lo[p] : hi[p]]
                code[x, : size[item[p]]] = self.codes[item[p]]
            score, end, last_row = align(region, code)
            share = score / (MATCH * size[item[part]])
            for x in np.flatnonzero(share >= self.threshold):
                p = part[x]
                back, begin, _ = align(region[x : x + 1, : end[x]][:, ::-1], code[x : x + 1, : last_row[x]][:, ::-1])
                key = (int(row[p]), int(item[p]))
                s, e = int(lo[p] - rows[row[p]] + end[x] - begin[0]), int(lo[p] - rows[row[p]] + end[x])
                if key not in out or (share[x], -s) > (out[key][0], -out[key][1]):
                    out[key] = (float(share[x]), s, e)
        return [(r, t, *v) for (r, t), v in out.items()]


def matchers(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, min_words: int = 1, block: int = ITEMS, block_chars: int = ITEM_CHARS):
    """Yields a ``Matcher`` for each block of items; a pass over the documents counts the words of its items.

    Null items, and those of fewer than ``min_words`` words, are left out.
    """
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    least = None
    while True:
        rest = items if least is None else items.filter((F.col("i") > least.i) | ((F.col("i") == least.i) & (F.col("t") > least.t)))
        sizes = [r.n for r in rest.orderBy("i", "t").limit(block).select(F.length("t").alias("n")).collect()]
        if not sizes:
            return
        part = rest.orderBy("i", "t").limit(max(1, int(np.searchsorted(np.cumsum(sizes), block_chars, "right")))).collect()
        least = part[-1]
        yield _matcher(docs.select(F.col(text_col).cast("string").alias("text")), part, threshold, min_words)


def _matcher(docs: DataFrame, part: list, threshold: float, min_words: int) -> Matcher:
    ids, codes = [], []
    for i, j, h, rows in _terms(pa.array([r.t for r in part])):
        for k in range(i, j):
            c = h[rows[k - i] : rows[k - i + 1]]
            if len(c) >= max(min_words, 1):
                ids.append(part[k].i)
                codes.append(c.copy())
    vocab = np.unique(np.concatenate(codes)) if codes else np.zeros(0, U)

    def count(batches):
        total = np.zeros(len(vocab) + 1, np.int64)
        for b in batches:
            for _, _, h, _ in _terms(b.column(0)):
                k = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
                if len(vocab):
                    total[:-1] += np.bincount(k[vocab[k] == h], minlength=len(vocab))
                total[-1] += len(h)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    seen = np.zeros(len(vocab) + 1, np.int64)
    for r in docs.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # the items' words
        seen[r.k] = r.n
    rare = -np.log((seen[:-1] + 1) / (seen[-1] + 1))
    found: dict[int, list] = {}
    for t, c in enumerate(codes):
        k = min(SEED, len(c))
        g, _ = grams(c, np.array([0, len(c)]), k)
        info = np.convolve(rare[np.searchsorted(vocab, c)], np.ones(k), "valid")
        keep = {int(x + info[x : x + SPREAD].argmax()) for x in range(max(1, len(g) - SPREAD + 1))}
        found.setdefault(k, []).extend((int(g[x]), t, x) for x in sorted(keep))
    tables = []
    for k, rows in found.items():
        seeds, owners, places = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (U, np.int64, np.int64), strict=True))
        order = np.argsort(seeds, kind="stable")
        uniq, first = np.unique(seeds[order], return_index=True)
        tables.append(Seeds(k, uniq, np.append(first, len(seeds)), owners[order], places[order]))
    return Matcher(np.array(ids, np.int64), codes, tables, threshold)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, **names) -> DataFrame:
    """``(id, item_id, score, first_word, end_word)``: the best alignment of each document with each item.

    ``score`` is the alignment's share of the item's score with itself; pairs below ``threshold`` are left
    out, and of places with equal scores the earliest is told. Words are lower-case runs of letters, digits and non-ASCII
    characters. Items of fewer words than a seed are their own seed; those below ``min_words`` are left out. A null or
    empty text matches nothing; texts and items of any length are read whole; null ids stay, repeated rows give repeated
    rows, repeated items count once, empty tables give an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, score double, first_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    first = True
    for m in matchers(docs, items, text_col, threshold=threshold, **names):
        part = rows.mapInArrow(_finder(m), schema)
        out, first = part if first else out.unionByName(part), False
    return out


def _finder(m: Matcher):
    def run(batches):
        for b in batches:
            got = m.match(b.column(1))
            if got:
                r, t, s, f, e = (np.array(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(m.item_ids[t]), pa.array(s), pa.array(f.astype(np.int32)), pa.array(e.astype(np.int32))], ["id", "item_id", "score", "first_word", "end_word"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.6, **names) -> DataFrame:
    """``docs`` without the rows that ``contamination`` finds, all columns as they are.

    Rows are judged by their texts alone: null ids stay or go as others do, repeated rows alike, null and empty texts
    stay. An empty table gives an empty one; without items every row stays.
    """
    cols = docs.columns
    at = cols.index(text_col)
    for m in matchers(docs, items, text_col, threshold=threshold, **names):

        def run(batches, m=m):
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                bad[[x[0] for x in m.match(b.column(at))]] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
