"""Substring dedup with repeated-phrase automata.

Three passes over blocks of documents:

1. *Seeds.* Each window of ``width`` words is represented by the least hash of its runs of ``SEED`` words. Two
   equal windows have equal seeds, so a window whose seed occurs in one document only cannot recur. Blocks
   send their distinct seeds to shards by hash; shards answer with those that recur.
2. *Confirm.* Blocks send the passages that recurring seeds cover, once per block and with the least and
   greatest id that has them. Shards compare their windows and answer each block with the passages that hold
   a window of a document with a smaller id: for each of their windows the least id.
3. *Locate.* Each block compiles its confirmed passages into Aho-Corasick automata and streams its documents
   through them; every word of an occurrence in a document with a greater id than a window's least is removed.

Blocks and shards are bounded by design: a block by its bytes of text, a shard by its range of hashes, and
each block sends a seed or passage once, so no passage, however common, fills a task. A seed that stands in many different
passages is hot: its windows go to shards one by one, by hashes of their own.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import materialize
from ._words import U, buffers, grams, sliding_min, words

SEED = 6
#: Bytes of text in a block, and for each shard of seeds and passages.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 24 << 20
#: Windows of a seed in all blocks from which it is hot, and in one block from which they are counted as so many.
HOT, MANY = 4096, 64
#: Letters of the automata: words hashed into code points without surrogates.
_LETTERS = 0x10FFFF - 0x800 - 1
PHRASES = 50_000
COPY = np.dtype([("id", np.int64), ("md5", np.uint8, (16,))])


def _letters(code: np.ndarray) -> np.ndarray:
    c = (code % U(_LETTERS)).astype(np.uint32) + np.uint32(1)
    return np.where(c >= 0xD800, c + np.uint32(0x800), c).astype(np.uint32)


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


class _Block:
    """Words, windows and seeds of a block's documents, copies left out."""

    def __init__(self, t: pa.Table, width: int, copies: np.ndarray) -> None:
        ids = t["doc_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.text = t["text"].combine_chunks().take(pa.array(self.order)) if t.num_rows else pa.array([], pa.string())
        self.bytes, self.offs = buffers(self.text)
        self.copy = np.isin(self.ids, copies["id"])
        known = set(zip(copies["id"].tolist(), map(bytes, copies["md5"]), strict=True))
        for d in np.flatnonzero(self.copy):
            self.copy[d] = (int(self.ids[d]), hashlib.md5(self.bytes[self.offs[d] : self.offs[d + 1]]).digest()) in known
        self.starts, self.ends, self.h, self.rows = words(self.bytes, self.offs)
        self.width = width
        self.code = self.h >> U(16)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.rows))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window, its seed), in documents that are no copies."""
        n, w = len(self.h), self.width
        if n < w:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero((self.row[: n - w + 1] == self.row[w - 1 :]) & ~self.copy[self.row[: n - w + 1]])
        one = np.array([0, n])
        seeds, _ = grams(self.h, one, min(SEED, w))
        return at, sliding_min(seeds, w - min(SEED, w) + 1)[at]


def _split(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the shards' ranges in ascending 64-bit keys."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _numbers(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _blobs(side: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(side["kind"].to_pylist(), side["data"].to_pylist(), strict=True) if k == kind] if side.num_rows else []


def _window_hashes(codes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of w columns of a matrix of words' hashes."""
    out = []
    for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        g = np.zeros((len(codes), codes.shape[1] - w + 1), U)
        for j in range(w):
            g *= U(m)
            g += codes[:, j : j + g.shape[1]]
        out.append(g)
    return out[0], out[1]


def _passages(b: _Block, seeds: np.ndarray):
    """The passages of recurring seeds: stretches of windows with one seed, as rows of 2*width-SEED words.

    ``seeds`` have their lowest two bits cleared but for the mark of hot ones, whose windows are passages each. Returns the
    number that deals them to shards, words' 48-bit codes (0 where a passage ends before the row does), number of
    windows and document.
    """
    at, seed = b.windows()
    if len(seeds) and len(at):
        bare = seeds & ~U(3)
        k = np.minimum(np.searchsorted(bare, seed & ~U(3)), len(seeds) - 1)
        hit = bare[k] == seed & ~U(3)
        hot = ((seeds[k] & U(1)) == 1)[hit]
    else:
        hit, hot = np.zeros(len(at), bool), np.zeros(0, bool)
    at, seed = at[hit], seed[hit]
    most = b.width - min(SEED, b.width) + 1
    new = np.ones(len(at), bool)
    new[1:] = hot[1:] | (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1]) | (b.row[at[1:]] != b.row[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    if (n > most).any():  # a seed that repeats itself: stretches are cut
        cut = np.zeros(len(at), bool)
        pos = np.arange(len(at)) - np.repeat(first, n)
        cut[pos % most == 0] = True
        first = np.flatnonzero(cut)
        n = np.diff(np.append(first, len(at)))
    long = b.width + most - 1
    start = at[first]
    idx = start[:, None] + np.arange(long)
    codes = np.where(np.arange(long) < (n + b.width - 1)[:, None], b.code[np.minimum(idx, max(0, len(b.h) - 1))] if len(b.h) else U(0), U(0))
    deal = seed[first]
    if hot.any():
        own = hot[first]
        deal[own] = _window_hashes(codes[own], b.width)[0][:, 0]
    return deal, codes, n, b.ids[b.row[start]] if len(start) else np.zeros(0, np.int64)


def remove_repeats(df: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for every row of ``df``.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id.
    Windows are judged on the input. ``kept`` joins the words that stay by one space. A null or empty text has
    no words; a text of any length is read whole, in one block. A row without id is compared with none: all its words stay.
    Rows that share an id are one another's equals, so neither loses words to the other. An empty table gives an
    empty one; further columns are not read, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, shards = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // SHARD_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    known = rows.filter("doc_id is not null")
    dealt = known.select(block.alias("block"), "doc_id", "text")

    digest = materialize(known.select("doc_id", F.md5("text").alias("m"), F.octet_length("text").alias("l")))
    lead = digest.groupBy("m", "l").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("times")).filter("lead < last").drop("last")
    copies = lookup(digest, lead, ["m", "l"], "times", n).filter("doc_id > lead")
    # 24 bytes a copy: the id, low byte first, and the digest
    swapped = F.concat(*[F.substring(F.lpad(F.hex("doc_id"), 16, "0"), 15 - 2 * i, 2) for i in range(8)])
    record0 = F.unhex(F.concat(swapped, "m"))
    side0 = copies.select(block.alias("block"), F.lit(0).alias("kind"), record0.alias("data"))
    sent = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
    back = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

    def seeds_of(key, docs, side):
        if not docs.num_rows:
            return sent.empty_table()
        b = _Block(docs, width, _numbers(_blobs(side, 0), COPY))
        at, seed = b.windows()
        order = np.argsort(seed, kind="stable")
        seed, row = seed[order] & ~U(3), b.ids[b.row[at[order]]]
        new = np.ones(len(seed), bool)
        new[1:] = seed[1:] != seed[:-1]
        first = np.flatnonzero(new)
        uniq = seed[first]
        # the lowest bits tell whether the block has the seed in one document, in two, or in many windows
        twice = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first) if len(first) else np.zeros(0, bool)
        uniq = uniq | np.where(twice, np.where(np.diff(np.append(first, len(seed))) >= MANY, 2, 1), 0).astype(U)
        cut = _split(uniq, shards)
        parts = [(s, uniq[cut[s] : cut[s + 1]].tobytes()) for s in range(shards) if cut[s + 1] > cut[s]]
        return pa.table([pa.array([s for s, _ in parts], pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([d for _, d in parts], pa.binary())], schema=sent)

    def recurring(key, t):
        blocks_, data = t["block"].to_pylist(), t["data"].to_pylist()
        parts = [np.frombuffer(d, U) for d in data]
        every = np.concatenate(parts)
        every.sort()
        bare = every & ~U(3)
        first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
        # windows in all blocks, each counted as the least its mark stands for, and blocks
        seen = np.add.reduceat(np.array([1, 2, MANY])[(every & U(3)).astype(np.int64)], first)
        known_, hot = bare[first], seen >= HOT
        back_ = known_ | hot.astype(U)
        known_, back_ = known_[seen > 1], back_[seen > 1]
        out = []
        for b, p in zip(blocks_, parts, strict=True):
            p = p & ~U(3)
            k = np.minimum(np.searchsorted(known_, p), max(0, len(known_) - 1))
            out.append((b, back_[k[known_[k] == p]] if len(known_) else known_))
        out = [(b, d.tobytes()) for b, d in out if len(d)]
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], schema=back)

    side1 = dealt.groupBy("block").cogroup(side0.groupBy("block")).applyInArrow(seeds_of, "shard int, block int, data binary")
    side1 = side0.unionByName(side1.groupBy("shard").applyInArrow(recurring, "block int, kind int, data binary"))
    long = width + width - min(SEED, width)
    record = np.dtype([("low", np.int64), ("high", np.int64), ("n", np.int32), ("upper", np.uint32, (long,)), ("lower", np.uint16, (long,))])

    def passages_of(key, docs, side):
        if not docs.num_rows:
            return sent.empty_table()
        b = _Block(docs, width, _numbers(_blobs(side, 0), COPY))
        seeds = np.sort(_numbers(_blobs(side, 1), U))
        seed, codes, n, doc = _passages(b, seeds)
        if not len(seed):
            return sent.empty_table()
        out = np.zeros(len(seed), record)
        out["low"], out["high"], out["n"] = doc, doc, n
        out["upper"], out["lower"] = codes >> U(16), codes & U(0xFFFF)
        out, seed = _merge(out, codes, seed)
        order = np.argsort(seed, kind="stable")
        out, cut = out[order], _split(seed[order], shards)
        parts = [(s, out[cut[s] : cut[s + 1]].tobytes()) for s in range(shards) if cut[s + 1] > cut[s]]
        return pa.table([pa.array([s for s, _ in parts], pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([d for _, d in parts], pa.binary())], schema=sent)

    def _merge(out: np.ndarray, codes: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One record for equal passages, with the least and greatest id."""
        a, c = _window_hashes(codes, long)
        order = np.lexsort((c[:, 0], a[:, 0]))
        a, c = a[order, 0], c[order, 0]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(out["low"][order], first), np.maximum.reduceat(out["high"][order], first)
        got = out[order[first]].copy()
        got["low"], got["high"] = low, high
        return got, seed[order[first]]

    found = np.dtype([("n", np.int32), ("check", U), ("letters", np.uint32, (long,)), ("least", np.int64, (long - width + 1,))])

    def confirmed(key, t):
        data = [np.frombuffer(d, record) for d in t["data"].to_pylist()]
        every = np.concatenate(data)
        codes = (every["upper"].astype(U) << U(16)) | every["lower"]
        a, c = _window_hashes(codes, width)
        real = np.arange(a.shape[1]) < every["n"][:, None]
        row = np.nonzero(real)[0]
        a, c = a[real], c[real]
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(every["low"][row[order]], first), np.maximum.reduceat(every["high"][row[order]], first)
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        # a window goes on to the blocks only where a greater id has it than the least
        none = np.iinfo(np.int64).max
        least = np.full(real.shape, none)
        least[real] = np.where(high > low, low, none)[group]
        out, at = [], 0
        for b, d in zip(t["block"].to_pylist(), data, strict=True):
            l, r, v = least[at : at + len(d)], d, codes[at : at + len(d)]
            at += len(d)
            use = (l < r["high"][:, None]).any(1)
            if use.any():
                f = np.zeros(int(use.sum()), found)
                f["n"], f["least"] = r["n"][use], l[use]
                f["letters"], f["check"] = _letters(v[use]), _window_hashes(v[use], long)[0][:, 0]
                out.append((b, f.tobytes()))
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([2] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], schema=back)

    side2 = dealt.groupBy("block").cogroup(side1.groupBy("block")).applyInArrow(passages_of, "shard int, block int, data binary")
    side2 = side0.unionByName(side2.groupBy("shard").applyInArrow(confirmed, "block int, kind int, data binary"))
    result = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def locate(key, docs, side):
        if not docs.num_rows:
            return result.empty_table()
        b = _Block(docs, width, _numbers(_blobs(side, 0), COPY))
        gone = np.zeros(len(b.h) + 1, np.int64)
        known = _numbers(_blobs(side, 2), found)
        for i in range(0, len(known), PHRASES):
            _stream(b, known[i : i + PHRASES], gone)
        removed = np.cumsum(gone)[:-1] > 0
        counts = np.diff(b.rows)
        # a copy of a smaller id's text keeps nothing once it has a window at all
        whole = b.copy & (counts >= width)
        removed |= whole[b.row]
        return _kept(b, counts, removed)

    def _stream(b: _Block, phrases: np.ndarray, gone: np.ndarray) -> None:
        """Mark the words of every occurrence; ``gone`` holds +1 and -1 at the ends of spans."""
        auto = ahocorasick.Automaton()
        n, texts = phrases["n"], _string(phrases["letters"].ravel())
        again = []
        for k, m in enumerate(n.tolist()):
            s = texts[k * long : k * long + m + width - 1]
            if auto.exists(s):  # other words of the same letters
                again.append(k)
            else:
                auto.add_word(s, k)
        if again:
            _stream(b, phrases[again], gone)
        auto.make_automaton()
        letters = _string(_letters(b.code))
        ks, ends = [], []
        for d in np.flatnonzero(~b.copy & (np.diff(b.rows) >= width)):
            lo = int(b.rows[d])
            for end, k in auto.iter(letters[lo : int(b.rows[d + 1])]):
                ks.append(k)
                ends.append(lo + end)
        ks, ends = np.array(ks, np.int64), np.array(ends, np.int64)
        for i in range(0, len(ks), 1 << 16):
            k, m = ks[i : i + (1 << 16)], n[ks[i : i + (1 << 16)]]
            at = ends[i : i + (1 << 16)] - (m + width - 1) + 1
            place = at[:, None] + np.arange(long)
            codes = np.where(np.arange(long) < (m + width - 1)[:, None], b.code[np.minimum(place, len(b.code) - 1)], U(0))
            sure = _window_hashes(codes, long)[0][:, 0] == phrases["check"][k]
            hit = (phrases["least"][k] < b.ids[b.row[at]][:, None]) & (np.arange(long - width + 1) < m[:, None]) & sure[:, None]
            first = (at[:, None] + np.arange(long - width + 1))[hit]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + width, -1)

    def _kept(b: _Block, counts: np.ndarray, removed: np.ndarray) -> pa.Table:
        keep = ~removed
        mask = np.zeros(len(b.bytes) + 1, np.int8)
        s, e = b.starts[keep], b.ends[keep]
        np.add.at(mask, s, 1)
        np.add.at(mask, e, -1)
        inside = np.cumsum(mask[:-1], dtype=np.int8) > 0
        data = b.bytes.copy()
        rows = b.row[keep]
        later = np.ones(len(s), bool)
        later[:1] = False
        later[1:] = rows[1:] == rows[:-1]
        gap = s[later] - 1
        data[gap] = 32
        inside[gap] = True
        kind = np.int32 if len(inside) < 1 << 31 else np.int64
        ends = np.concatenate([np.zeros(1, kind), np.cumsum(inside, dtype=kind)])[b.offs]
        flat = data[inside]
        kept = pa.Array.from_buffers(pa.large_string(), len(b.ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.string())
        lost = np.bincount(b.row, removed, len(b.ids)).astype(np.int64)
        return pa.table([pa.array(b.ids), pa.array(counts.astype(np.int64)), pa.array(lost), kept], schema=result)

    out = dealt.groupBy("block").cogroup(side2.groupBy("block")).applyInArrow(locate, "id long, n_words long, n_removed long, kept string")
    loose = rows.filter("doc_id is null").select(
        F.col("doc_id").alias("id"),
        F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")).alias("w"),
    )
    return out.unionByName(loose.select("id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.concat_ws(" ", "w").alias("kept")))
