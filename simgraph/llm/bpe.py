"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

Sufficient lookahead
--------------------
Take two inputs that share a prefix and apply the merges to both in order. Let ``d`` be the end of the
longest common run of tokens. A merge ``(a, b)`` can move ``d`` only when the last common token is ``a``
and a ``b`` follows it in just one of the inputs; ``d`` then falls by ``len(a)``. Where ``d`` has
been moved by an earlier merge ``(a', b')``, every token that can start at ``d`` afterwards has ``a'`` on
the left edge of its derivation. So a fall by ``(a, b)`` extends only chains that end in a merge of lower
number whose ``a'`` lies on the left edge of ``b``, and the longest chain, weighed by ``len(a)``, bounds
how far before the end of what has been read a token may still change. ``lookahead`` is that bound; it is
computed once from the merge list in one pass.

A token that ends at least ``lookahead`` bytes before the end of what has been read never changes, and
no merge crosses its end, so it is emitted and the bytes behind it are forgotten. The transducer holds
``lookahead`` bytes and one block at most, however long the text is.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts texts before byte-level merges.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PRETOKEN)
#: A space before a character that is no white space under any reading always starts a pretoken.
_SAFE = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
#: Any other space.
_LOOSE = re.compile(r" (?:[\s\x1c-\x1f\x85]|\Z)")
BLOCK = 1 << 12
CHUNK = 1 << 16
CACHE = 1 << 17
#: Characters of texts whose words are merged together.
GROUP = 1 << 21
_NONE = 1 << 60


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


class _Cache:
    """A bounded map of two generations: what is not asked for again goes at the second turn."""

    def __init__(self, size: int = CACHE) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.size = size

    def get(self, k):
        v = self.new.get(k)
        if v is None:
            v = self.old.get(k)
            if v is not None:
                self.put(k, v)
        return v

    def put(self, k, v) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[k] = v


class ByteBPE:
    """Vocabulary and merges of a ``tokenizers`` JSON file."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        chars = byte_chars()
        self.byte_id = [vocab.get(chars[b]) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        left: dict[int, int] = {}
        fall, worst = {}, 0
        for rank, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            self.merges.setdefault((a, b), (rank, ab))
            t, far = b, 0
            while t is not None:
                far = max(far, fall.get(t, 0))
                t = left.get(t)
            far += len(self.bytes_of[a])
            fall[a] = max(fall.get(a, 0), far)
            left.setdefault(ab, a)
            worst = max(worst, far)
        self.lookahead = worst
        self._rank = {a << 20 | b: r for (a, b), (r, _) in self.merges.items()}
        self._made = {r: ab for r, ab in self.merges.values()}
        self._pairs = _Pairs(self._rank, self._made)
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._spelling = _Spelling(self.bytes_of)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._words = _Cache()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken's bytes held as a whole."""
        ids = list(map(self.byte_id.__getitem__, data))
        if len(ids) > 64:
            return self._merge_long(ids)
        get, made = self._rank.get, self._made
        ranks = [get(a << 20 | b, _NONE) for a, b in pairwise(ids)]
        while ranks:
            r = min(ranks)
            if r == _NONE:
                break
            i = ranks.index(r)
            ids[i] = x = made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(x << 20 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | x, _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        ids = list(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if r := get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (p := prv[i]) >= 0 and (r := get((ids[p], ids[i]))):
                heapq.heappush(heap, (r[0], p, ids[p], ids[i]))
        return [t for t in ids if t is not None]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pretokens of 1 to 64 bytes in one array, and their number in each: those of like length go
        together, one merge of each at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, counts, pieces = sizes.argsort(kind="stable"), sizes.copy(), []
        byte_id = np.array(self.byte_id, np.int32)
        for k in range(0, len(order), _ROWS):
            who = order[k : k + _ROWS]
            size = sizes[who]
            # a column more than the longest, so that every pair's right neighbour is there
            ids = np.full((len(who), size[-1] + 1), -1, np.int32)
            ids[np.arange(size[-1] + 1) < size[:, None]] = byte_id[np.frombuffer(b"".join([words[i] for i in who.tolist()]), np.uint8)]
            ranks = self._pairs.ranks(ids[:, :-1], ids[:, 1:])
            while len(who):
                at = ranks.argmin(1)
                best = ranks[np.arange(len(who)), at]
                if (done := best == _Pairs.NONE).any():
                    pieces.append((who[done], ids[done]))
                    on = ~done
                    who, ids, ranks, at, best = who[on], ids[on], ranks[on], at[on], best[on]
                    if not len(who):
                        break
                rows = np.arange(len(who))
                ids[rows, at] = made = self._pairs.made[best]
                ids = _without(ids, at + 1)
                ranks = _without(ranks, at)
                ranks[rows, at] = self._pairs.ranks(made, ids[rows, at + 1])
                rows = np.flatnonzero(at)
                before = at[rows] - 1
                ranks[rows, before] = self._pairs.ranks(ids[rows, before], made[rows])
                counts[who] -= 1
        starts = counts.cumsum() - counts
        out = np.empty(counts.sum(), np.int32)
        for who, ids in pieces:
            cols = np.arange(ids.shape[1])
            there = cols < counts[who][:, None]
            out[(starts[who][:, None] + cols)[there]] = ids[there]
        return out, counts

    def pretoken(self, word: str) -> bytes:
        """Packed ids of one pretoken."""
        ids = self._words.get(word)
        if ids is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > BLOCK:
                t = Transducer(self)
                return pack([*t.push(data), *t.finish()])
            ids = pack(self.merge(data))
            if len(data) <= 64:
                self._words.put(word, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        if len(text) > BLOCK:
            return self._plain_all([text])[0]
        return b"".join(map(self.pretoken, _SPLIT.findall(text)))

    def _plain_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens; a word that many hold is looked at once.

        Texts are cut at spaces that start a pretoken, and their parts numbered by content; the first part of each has no
        space before it and gets a number of its own.
        """
        parts, lens = self._parts(texts)
        if None in self.byte_id or parts is None:
            return [b"".join(map(self.pretoken, _SPLIT.findall(t))) for t in texts]
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        alpha = np.fromiter(map(str.isalpha, distinct), bool, len(distinct))
        lone = [" " + p for p, a in zip(distinct, alpha.tolist(), strict=True) if a]
        # parts of one pretoken come first, then the others, then the first part of each text
        numbers = np.where(alpha, alpha.cumsum(), len(lone) + (~alpha).cumsum())[coded.indices.to_numpy()] - 1
        ends = lens.cumsum()
        numbers[ends - lens] = len(distinct) + np.arange(len(texts))
        n_words, words = [1] * len(lone), []
        for p, a in zip(distinct, alpha.tolist(), strict=True):
            if not a:
                pre = self._pretokens(p)
                n_words.append(len(pre))
                words += pre
        for i in (ends - lens).tolist():
            pre = _SPLIT.findall(parts[i].as_py())
            n_words.append(len(pre))
            words += pre
        place = {w: i for i, w in enumerate(dict.fromkeys(words), len(lone))}
        which = np.fromiter(chain(range(len(lone)), map(place.__getitem__, words)), np.int64, len(lone) + len(words))

        words = lone + list(place)
        data = [w.encode() for w in words]
        short = np.fromiter(map(len, data), np.int64, len(data)) <= 64
        ids, counts = self.merge_all([d for d in data if len(d) <= 64])
        long = [np.frombuffer(self.pretoken(words[i]), np.int32) for i in np.flatnonzero(~short).tolist()]
        size = np.empty(len(data), np.int64)
        size[short], size[~short] = counts, [len(x) for x in long]
        start = np.empty(len(data), np.int64)
        start[short] = counts.cumsum() - counts
        start[~short] = len(ids) + size[~short].cumsum() - size[~short]
        ids = np.concatenate([ids, *long])

        where, upto = _runs(start, size, which)
        ids, upto = ids[where], np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(n_words)])]
        where, tokens = _runs(upto[:-1], np.diff(upto), numbers)
        raw = ids[where].tobytes()
        at = (4 * tokens[ends - 1]).tolist()
        return [raw[x:y] for x, y in pairwise([0, *at])]

    @staticmethod
    def _parts(texts: list[str]) -> tuple[pa.Array | None, np.ndarray]:
        """Parts of all texts, and their number in each; None where a text holds what UTF-8 does not."""
        loose = {i: list(_cut(t)) for i, t in enumerate(texts) if _LOOSE.search(t) is not None}
        try:
            split = pc.split_pattern(pa.array(["" if i in loose else t for i, t in enumerate(texts)], pa.string()), " ")
            if not loose:
                return split.values, split.value_lengths().to_numpy().astype(np.int64)
            more = pa.array(list(chain.from_iterable(loose.values())), pa.string())
        except UnicodeEncodeError:
            return None, np.zeros(0, np.int64)
        # a text that was cut by hand stands as one empty part so far
        lens = split.value_lengths().to_numpy().astype(np.int64)
        start, at = lens.cumsum() - lens, list(loose)
        lens[at] = [len(c) for c in loose.values()]
        start[at] = len(split.values) + lens[at].cumsum() - lens[at]
        where, _ = _runs(start, lens, np.arange(len(texts)))
        return pa.concat_arrays([split.values, more]).take(pa.array(where)), lens

    @staticmethod
    def _pretokens(p: str) -> list[str]:
        """Pretokens of a space and what follows it, which starts with no white space."""
        if p.isalpha():
            return [" " + p]
        if p[-1:] in (",", ".") and p[:-1].isalpha():
            return [" " + p[:-1], p[-1]]
        return _SPLIT.findall(" " + p)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers; long texts go through ``encode_stream``."""
        if len(text) > CHUNK:
            return b"".join(self.encode_stream(text[k : k + CHUNK] for k in range(0, len(text), CHUNK)))
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        return b"".join(self.encode_stream([text]))

    def encode_rows(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, null ones empty; plain short texts go together, ``GROUP`` characters or so at a time."""
        out: list[bytes] = [b""] * len(texts)
        group, n = [], 0
        for i, t in enumerate(texts):
            if t and (len(t) > CHUNK or self._special is not None and self._special.search(t)):
                out[i] = self.encode_packed(t)
            elif t:
                group.append(i)
                n += len(t)
            if group and (n >= GROUP or i + 1 == len(texts)):
                for k, ids in zip(group, self._plain_all([texts[k] for k in group]), strict=True):
                    out[k] = ids
                group, n = [], 0
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text that comes in chunks, each emitted as soon as it is stable.

        Held back are the start of a special token, the last run of one character class and, within it,
        ``lookahead`` bytes.
        """
        longest = max(map(len, self.special), default=0)
        buf, run = "", None

        def flush(s: str, last: bool):
            """Ids of what is stable in ``s``, and the rest."""
            nonlocal run
            out = bytearray()
            while s:
                if run is not None:
                    kind, t = run
                    k = kind.match(s).end() if kind.match(s) else 0
                    if k == len(s) and not last:
                        hold = 1 if kind is _SPACES else 0
                        out += pack(t.push(s[: k - hold].encode("utf-8", "surrogatepass")))
                        return out, s[k - hold :]
                    if kind is _SPACES and k < len(s):
                        k = max(0, k - 1)
                    out += pack(t.push(s[:k].encode("utf-8", "surrogatepass")))
                    out += pack(t.finish())
                    run, s = None, s[k:]
                    continue
                if last:
                    return out + self._plain(s), ""
                cut = None
                for cut in _SAFE.finditer(s):  # noqa: B007
                    pass
                if cut is not None and cut.start():
                    out += self._plain(s[: cut.start()])
                    s = s[cut.start() :]
                if len(s) < BLOCK:
                    return out, s
                words = _SPLIT.findall(s)
                for w in words[:-2]:
                    out += self.pretoken(w)
                s = "".join(words[-2:])
                if len(words) > 1 and len(s) >= BLOCK and not (words[-2].isspace() and len(words[-1]) == 1):
                    out += self.pretoken(words[-2])
                    s = words[-1]
                if len(s) < BLOCK:
                    return out, s
                body = s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else s
                kind = next((c for c in _RUNS if c.match(body) and c.match(body).end() == len(body)), None)
                if kind is None:
                    return out, s
                t = Transducer(self)
                run = (kind, t)
                out += pack(t.push(s[: len(s) - len(body)].encode()))
                s = body
            return out, ""

        for c in chunks:
            buf += c
            while self._special is not None and (m := self._special.search(buf)):
                ids, _ = flush(buf[: m.start()], True)
                yield bytes(ids) + pack([*self._end(run), self.special[m[0]]])
                run, buf = None, buf[m.end() :]
            # a special token may begin in what is held back
            tail = next((k for k in range(min(longest - 1, len(buf)), 0, -1) if any(s.startswith(buf[-k:]) for s in self.special)), 0)
            head, hold = (buf[:-tail], buf[-tail:]) if tail else (buf, "")
            ids, rest = flush(head, False)
            buf = rest + hold
            if ids:
                yield bytes(ids)
        ids, _ = flush(buf, True)
        yield bytes(ids) + pack(self._end(run))

    @staticmethod
    def _end(run) -> list[int]:
        return run[1].finish() if run is not None else []

    def decode_stream(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids that come in lists: bytes become characters once these are whole."""
        text = Utf8()
        for part in ids:
            yield text.push(self._spelling.join(part))
        yield text.finish()

    def decode(self, ids) -> str:
        """Text of a list or an array of ids."""
        if len(ids) <= CHUNK:
            return self._spelling.join(ids).decode("utf-8", "replace")
        return "".join(self.decode_stream(ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)))


class _Pairs:
    """Ranks of many pairs of tokens at once."""

    NONE = (1 << 31) - 1

    def __init__(self, rank: dict[int, int], made: dict[int, int]) -> None:
        keys = np.array([*rank, _NONE], np.int64)
        order = keys.argsort()
        self.keys, self.rank = keys[order], np.array([*rank.values(), self.NONE], np.int32)[order]
        self.made = np.zeros(max(made, default=-1) + 1, np.int32)
        self.made[list(made)] = list(made.values())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; ``NONE`` where there is none or a token is -1."""
        key = (a.astype(np.int64) << 20) + b
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)


class _Spelling:
    """Bytes of tokens, all in one array."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        top = max(bytes_of, default=-1) + 1
        size = np.full(top, -1, np.int64)
        size[list(bytes_of)] = [len(t) for t in bytes_of.values()]
        self.size, self.start = size, np.maximum(size, 0).cumsum() - np.maximum(size, 0)
        self.bytes = np.frombuffer(b"".join(bytes_of[i] for i in range(top) if i in bytes_of), np.uint8)

    def join(self, ids) -> bytes:
        """Bytes of all ids, in their order; an id that the vocabulary lacks raises."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0:
            raise KeyError(next(i for i in ids.tolist() if not 0 <= i < len(self.size) or self.size[i] < 0))
        return self.bytes[_runs(self.start, self.size, ids)[0]].tobytes()


def _runs(start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs asked for, one after the other, and where each ends among them."""
    n = size[which]
    ends = n.cumsum()
    at = np.repeat(start[which] - ends + n, n)
    at += np.arange(len(at))
    return at, ends


def _without(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A matrix that has lost one cell in each row."""
    return x[np.arange(x.shape[1]) != at[:, None]].reshape(len(x), -1)


_ROWS = 1 << 11


def pack(ids: list[int]) -> bytes:
    return _PACK[len(ids)].pack(*ids) if len(ids) < 64 else np.array(ids, np.int32).tobytes()


_PACK = [struct.Struct(f"={n}i") for n in range(64)]
_SPACES = regex.compile(r"\s+")
_RUNS = [regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), _SPACES]


def _cut(text: str) -> Iterator[str]:
    """What lies between the spaces that start a pretoken."""
    at = 0
    for m in _SAFE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Transducer:
    """One pretoken's bytes in, tokens out once ``lookahead`` further bytes make them stable."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.held = bpe, b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), BLOCK):
            self.held += data[k : k + BLOCK]
            if len(self.held) < BLOCK + self.bpe.lookahead:
                continue
            stable, at = len(self.held) - self.bpe.lookahead, 0
            for t in self.bpe._merge_long([self.bpe.byte_id[b] for b in self.held]):
                if at + len(self.bpe.bytes_of[t]) > stable:
                    break
                at += len(self.bpe.bytes_of[t])
                out.append(t)
            self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = (self.bpe.merge(self.held) if self.held else []), b""
        return out


class Utf8:
    """Bytes in, characters out; holds the three bytes at most of a character that is not whole yet."""

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for k in range(1, min(4, len(data) + 1)):
            b = data[-k]
            if b & 0xC0 != 0x80:
                need = 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 1
                keep = k if need > k else 0
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(4)
def load(path: str) -> ByteBPE:
    with open(path, encoding="utf-8") as f:
        return ByteBPE(f.read())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row.

    The vocabulary file is installed on every machine; only its path is sent. A null text is empty and
    has no ids; a null id stays null; repeated rows give repeated rows; an empty table gives an empty
    one; further columns of ``df`` are not read. Special tokens written in a text become their ids.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = b.column(1)
            for i in range(0, b.num_rows, 512):
                ids = bpe.encode_rows(texts.slice(i, 512).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 512), lists], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, vocabulary: str | None = None, id_col: str = "id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, decoded)`` for every row; null or empty ids decode to the empty text."""
    path = vocabulary or default_vocabulary()
    n = len(keep)

    def run(batches):
        bpe = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                ids = b.column(n + 1).slice(i, 512)
                flat = ids.flatten().to_numpy()
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
                texts = [bpe.decode(flat[x:y]) for x, y in pairwise([0, *ends])]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 512) for c in range(n + 1)), pa.array(texts, pa.string())], ["id", *keep, "decoded"])

    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(ids_col).alias("ids"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *keep))
    return rows.mapInArrow(run, f"{types}, decoded string")
