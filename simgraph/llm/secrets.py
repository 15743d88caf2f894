"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of twelve or more of ``A-Za-z0-9+/_.=-``, of any length. The network is convolved over all of
it, with the characters before and behind, and pooled over both parts apart. It is trained in numpy on labelled
findings; its scores are calibrated on findings kept apart, and the threshold of each shape of candidate
is the highest that keeps the recall asked for there.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "model")
#: The base patterns, letters of the keywords in either case.
_KEYS = "password passwd secret token api_?key"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"""({"|".join(map(_either, _KEYS.split()))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value all of whose parts are words or short numbers, or a word with a few digits behind it.
_PLAIN = re.compile(r"(?:(?:[A-Za-z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,8})")
_PARTS = re.compile(r"[+/_.=-]+")
#: Characters of context before and behind a candidate.
LEFT, RIGHT = 24, 8
#: Characters that one step of the network holds.
STEP = 1 << 16


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the base patterns, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int]]:
    """Runs long enough that overlap no base span; ``base`` is in order of start."""
    out, at, far = [], 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            far = max(far, base[at][1])
            at += 1
        if far <= s:
            out.append((s, e))
    return out


def harmless(value: str) -> bool:
    """Whether a value is made of words and short numbers only, as names of hosts, files and versions are."""
    return all(_PLAIN.fullmatch(p) for p in _PARTS.split(value) if p)


def _alphabet() -> np.ndarray:
    """A small alphabet: printable ASCII as itself, other characters and padding as one code each."""
    out = np.full(0x10000, 1, np.uint8)
    out[32:127] = np.arange(3, 98)
    out[[9, 10, 13]] = 2
    return out


_CODE = _alphabet()


def codes(text: str) -> np.ndarray:
    """A text's characters as codes between the paddings that its first and last candidates may need."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    out = np.zeros(LEFT + len(c) + RIGHT, np.uint8)
    out[LEFT : LEFT + len(c)] = _CODE[c]
    return out


def window(text: str, s: int, e: int) -> np.ndarray:
    """Codes of a whole candidate with its surroundings."""
    return codes(text)[s : e + LEFT + RIGHT]


SHAPES = 4


def shape(value: str) -> int:
    """0: lower-case hex, 1: letters and digits, 2: with other characters, 3: digits alone."""
    return 3 if value.isdigit() else 0 if re.fullmatch(r"[0-9a-f]+", value) else 1 if value.isalnum() else 2


@dataclass
class CharCNN:
    """Embedding, one convolution, maximum and mean over the places of context and candidate, one linear unit."""

    dim: int = 8
    span: int = 5
    filters: int = 24
    seed: int = 7
    w: dict = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple = (0.5,) * SHAPES
    recall: tuple = (0.0,) * SHAPES
    precision: tuple = (0.0,) * SHAPES

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        k = self.dim * self.span
        self.w = self.w or {
            "emb": r.normal(0, 0.5, (98, self.dim)),
            "conv": r.normal(0, (2 / k) ** 0.5, (k, self.filters)),
            "bias": np.zeros(self.filters),
            "out": r.normal(0, 0.1, 4 * self.filters),
            "b": np.zeros(1),
        }

    @property
    def cut(self) -> int:
        """Places before this one see the context ahead, those from it on the candidate and what follows."""
        return LEFT - self.span // 2

    def _forward(self, xs: list[np.ndarray]):
        n = np.array([len(x) for x in xs])
        x = np.zeros((len(xs), n.max()), np.uint8)
        for i, v in enumerate(xs):
            x[i, : len(v)] = v
        e = self.w["emb"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.span, 1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.dim * self.span)
        real = (np.arange(cols.shape[1]) < (n - self.span + 1)[:, None])[..., None]
        a = np.maximum(cols @ self.w["conv"] + self.w["bias"], 0) * real
        parts = (a[:, : self.cut], a[:, self.cut :])
        size = (np.full(len(x), self.cut, np.float32), (n - self.span + 1 - self.cut).astype(np.float32))
        pool = np.concatenate([f for p, k in zip(parts, size, strict=True) for f in (p.max(1), p.sum(1) / k[:, None])], 1)
        return x, cols, a, real, parts, size, pool, pool @ self.w["out"] + self.w["b"][0]

    def fit(self, xs: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3) -> CharCNN:
        r = np.random.default_rng(self.seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step, f = 0, self.filters
        length = np.array([len(x) for x in xs])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        for _ in range(epochs):
            # windows of like length share a batch, so that little is padded
            order = r.permutation(len(xs))
            order = np.concatenate([part[np.argsort(length[part], kind="stable")] for part in np.array_split(order, max(1, len(xs) // 1024))])
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            for i in r.permutation(len(batches)):
                part = batches[i]
                x, cols, a, real, parts, size, pool, z = self._forward([xs[k] for k in part])
                dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
                g = {"out": pool.T @ dz, "b": np.array([dz.sum()], np.float32)}
                dp = dz[:, None] * self.w["out"]
                da = np.zeros_like(a)
                for k, (lo, p) in enumerate(((0, parts[0]), (self.cut, parts[1]))):
                    at = p.argmax(1)
                    np.put_along_axis(da[:, lo : lo + p.shape[1]], at[:, None, :], dp[:, None, 2 * k * f : (2 * k + 1) * f], 1)
                    da[:, lo : lo + p.shape[1]] += dp[:, None, (2 * k + 1) * f : (2 * k + 2) * f] / size[k][:, None, None]
                da *= (a > 0) & real
                g["bias"] = da.sum((0, 1))
                g["conv"] = np.tensordot(cols, da, ((0, 1), (0, 1)))
                dc = (da @ self.w["conv"].T).reshape(len(x), -1, self.span, self.dim)
                de = np.zeros((*x.shape, self.dim), np.float32)
                for k in range(self.span):
                    de[:, k : k + dc.shape[1]] += dc[:, :, k]
                g["emb"] = np.stack([np.bincount(x.ravel(), de[..., k].ravel(), 98) for k in range(self.dim)], 1).astype(np.float32)
                step += 1
                for k, v in g.items():
                    m[k][0] = 0.9 * m[k][0] + 0.1 * v
                    m[k][1] = 0.999 * m[k][1] + 0.001 * v * v
                    self.w[k] = self.w[k] - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)
        return self

    def _taps(self) -> np.ndarray:
        """What each character adds to the filters from each place of their span."""
        return np.einsum("cd,kdf->kcf", self.w["emb"], self.w["conv"].reshape(self.span, self.dim, -1)).astype(np.float32)

    def logits(self, xs: list[np.ndarray]) -> np.ndarray:
        """Logits of windows of any length, ``STEP`` characters at a time."""
        taps, bias = self._taps(), self.w["bias"].astype(np.float32)
        top, total = np.zeros((2, len(xs), self.filters), np.float32), np.zeros((2, len(xs), self.filters))
        size = np.array([len(x) for x in xs], np.int64)
        i = 0
        while i < len(xs):
            j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), STEP, "right")) + i)
            if j == i + 1:
                pieces = [(xs[i][at : at + STEP + self.span - 1], at) for at in range(0, int(size[i]) - self.span + 1, STEP)]
            else:
                pieces = [(np.concatenate(xs[i:j]), 0)]
            for flat, before in pieces:
                a = np.repeat(bias[None], len(flat) - self.span + 1, 0)
                for k in range(self.span):
                    a += taps[k][flat[k : k + len(a)]]
                np.maximum(a, 0, out=a)
                # the first place of each window, its first place on the candidate, and one behind its last
                start = np.cumsum(size[i:j]) - size[i:j] - before
                for p, lo, hi in ((0, start, start + self.cut), (1, start + self.cut, start + size[i:j] - self.span + 1)):
                    lo, hi = np.clip(lo, 0, len(a)), np.clip(hi, 0, len(a))
                    use = np.flatnonzero(hi > lo)
                    if len(use):
                        at = np.stack([lo[use], hi[use]], 1).ravel()
                        at = at[:-1] if at[-1] == len(a) else at
                        top[p, i + use] = np.maximum(top[p, i + use], np.maximum.reduceat(a, at)[::2])
                        total[p, i + use] += np.add.reduceat(a, at)[::2]
            i = j
        n = np.stack([np.full(len(xs), self.cut), size - self.span + 1 - self.cut])
        pool = np.concatenate([f for p in (0, 1) for f in (top[p], total[p] / n[p][:, None])], 1)
        return pool @ self.w["out"] + self.w["b"][0]

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(xs) + self.shift, -30, 30))) if len(xs) else np.zeros(0)

    def calibrate(self, xs: list[np.ndarray], y: np.ndarray, shapes: np.ndarray, recall: float) -> CharCNN:
        """Platt scaling, then for each shape the highest threshold, 0.95 at most, that keeps ``recall``.

        The labelled negatives do not move it; ``recall`` and ``precision`` are what results on the findings given.
        """
        z = self.logits(xs) if len(xs) else np.zeros(0)
        t = (y * y.sum() + y) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2) if len(y) else y
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))
            self.slope -= 0.3 * float(np.mean((p - t) * z)) if len(z) else 0.0
            self.shift -= 0.3 * float(np.mean(p - t)) if len(z) else 0.0
        p, out, kept, right = self.scores(xs), [], [], []
        for k in range(SHAPES):
            good, bad = np.sort(p[(shapes == k) & (y == 1)]), p[(shapes == k) & (y == 0)]
            out.append(min(float(good[int((1 - recall) * len(good))]), 0.95) if len(good) else 0.5)
            hits = int((good >= out[k]).sum())
            kept.append(hits / max(len(good), 1))
            right.append(hits / max(hits + int((bad >= out[k]).sum()), 1))
        self.thresholds, self.recall, self.precision = tuple(out), tuple(kept), tuple(right)
        return self


def made_findings(n: int = 2400, seed: int = 11) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled findings in the usual forms of credentials, alone or inside longer runs, and look-alikes that are none."""
    r = random.Random(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghklmnprstvwz") * r.randint(0, 1) + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "t", "l"]) for _ in range(r.randint(1, 4)))
    good = [
        lambda: "ghp_" + pick(low + up + num, 36),
        lambda: "sk_live_" + pick(low + up + num, 24),
        lambda: "xoxb-" + pick(num, 11) + "-" + pick(low + up + num, 24),
        lambda: "eyJ" + pick(low + up + num, 30) + "." + pick(low + up + num + "_-", 40),
        lambda: pick(low + up + num + "+/", r.randint(28, 60)) + r.choice(["", "=", "=="]),
        lambda: pick(low + num, r.randint(24, 44)),
        lambda: pick(up + num, r.randint(20, 40)),
        lambda: "AIza" + pick(low + up + num + "_-", 35),
        lambda: pick("0123456789abcdef", r.choice([12, 13, 14, 15])),
    ]
    bad = [
        lambda: f"{word()}{r.randint(0, 99)}.{word()}.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}-{r.randint(1, 2999)}-{word()}",
        lambda: f"/{word()}/{word()}/{r.randint(1, 99999)}.{r.choice(['html', 'png', 'txt'])}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
        lambda: f"{word()}_{word()}_{r.randint(1, 99)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}-{word()}",
        lambda: word() + word() + r.choice(["", str(r.randint(1, 999))]) + word(),
        lambda: (word() + word() + word()).upper(),
        lambda: "-".join(word().title() for _ in range(4)),
        lambda: f"{word()}={r.randint(1, 99999)}-{word()}",
        lambda: "-" * r.randint(12, 60),
        lambda: "/".join(word() for _ in range(r.randint(4, 20))),
        lambda: pick(num, r.randint(12, 15)),
    ]
    around = [
        lambda v: v,
        lambda v: v,
        lambda v: v,
        lambda v: f"/{word()}/{word()}/{v}/{word()}/{word()}.html",
        lambda v: f"{word()}={word()}/{v}",
        lambda v: "/".join([word() for _ in range(r.randint(6, 12))] + [v] + [word() for _ in range(r.randint(2, 9))]),
    ]
    ahead = ["key: ", "auth ", "Bearer ", 'credential="', "use ", ""]
    out, y = [], []
    for i in range(n):
        is_secret = i % 2
        v = r.choice(good if is_secret else bad)()
        v = r.choice(around)(v) if is_secret else v
        v = v if len(v) >= 12 else v + "-" + word() + word() + word()
        left = " ".join(word() for _ in range(4)) + " " + (r.choice(ahead) if is_secret or r.random() < 0.3 else "")
        out.append((left + v + " " + word() + " " + word(), len(left), len(left) + len(v)))
        y.append(is_secret)
    return out, y


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 4000, sample_findings: int = 4000, sample_chars: int = 512, recall: float = 0.95) -> CharCNN:
    """Fit on labelled findings of at most ``sample_docs`` documents and on made ones.

    In the sample, the base patterns' values are labelled 1; candidates made of words and short numbers alone are
    labelled 0. What is neither stays unlabelled: an unknown key is not taught to be harmless. The documents are those
    of the least hash of id and length, so the choice is the same however the table is stored. At most
    ``sample_findings`` findings of at most ``sample_chars`` characters reach the driver. Null texts are empty; an
    empty table leaves the made findings.
    """
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.xxhash64("id", F.length("text"))
    edge = docs.select(order.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]

    def found(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                base = base_spans(t)
                rows = [(e - len(v), e, 1, v) for _, e, k, v in base if k != "hex"]
                rows += [(s, e, 0, t[s:e]) for s, e in candidates(t, base) if harmless(t[s:e])]
                rows = [r for r in rows if len(r[3]) <= sample_chars]
                if rows:
                    c = codes(t)
                    x = [c[s : e + LEFT + RIGHT].tobytes() for s, e, _, _ in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array([y for _, _, y, _ in rows], pa.int32()), pa.array([shape(v) for *_, v in rows], pa.int32())], ["x", "y", "k"])

    rows = []
    if edge is not None:
        got = docs.filter(order <= F.lit(edge)).select("text").mapInArrow(found, "x binary, y int, k int")
        rows = got.distinct().orderBy(F.xxhash64("x"), "x", "y").limit(sample_findings).collect()
    made, my = made_findings()
    x = [np.frombuffer(bytes(r.x), np.uint8) for r in rows] + [window(*m) for m in made]
    y = np.array([r.y for r in rows] + my, float)
    k = np.array([r.k for r in rows] + [shape(t[s:e]) for t, s, e in made])
    held = np.random.default_rng(3).random(len(y)) < 0.3
    pick = lambda use: [x[i] for i in np.flatnonzero(use)]
    return CharCNN().fit(pick(~held), y[~held]).calibrate(pick(held), y[held], k[held], recall)


def find(texts: list[str | None], model: CharCNN) -> list[list[tuple[int, int, str, float]]]:
    """``(start, end, kind, score)`` of all findings of each text, by start and kind; a null text is empty."""
    out, asked, where, size = [], [], [], 0

    def judge() -> None:
        for (d, s, e, k), p in zip(where, model.scores(asked), strict=True):
            if p >= model.thresholds[k]:
                out[d].append((s, e, "model", float(p)))
        asked.clear()
        where.clear()

    for d, t in enumerate(t or "" for t in texts):
        base = base_spans(t)
        out.append([(s, e, k, 1.0) for s, e, k, _ in base])
        runs = candidates(t, base)
        if runs:
            c = codes(t)
            asked += [c[s : e + LEFT + RIGHT] for s, e in runs]
            where += [(d, s, e, shape(t[s:e])) for s, e in runs]
            size += len(t)
        if size >= 1 << 22:
            judge()
            size = 0
    judge()
    for f in out:
        f.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def scan(df: DataFrame, model: CharCNN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, findings)`` for every row; findings are structs of kind, start, end, score, by start.

    Offsets are code points, the end exclusive. Base findings always stay; a candidate that overlaps none
    of them is added as kind ``model`` if its calibrated score reaches the threshold of its shape. Two findings
    that start together come in the order of kinds. A null text is empty and has no findings; a very long one is read as a
    whole; null ids stay, repeated rows give repeated rows, an empty table an empty one; columns not named are not read.
    """
    kind = "array<struct<kind:string,start:int,end:int,score:double>>"
    n = len(keep)
    spec = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                got = find(b.column(n + 1).slice(i, 512).to_pylist(), model)
                out = [[{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in f] for f in got]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 512) for c in range(n + 1)), pa.array(out, spec)], ["id", *keep, "findings"])

    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate((id_col, *keep))]
    rows = df.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    types = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(("id", *keep), rows.schema, strict=False))
    return rows.mapInArrow(run, f"{types}, findings {kind}")


def redact(df: DataFrame, model: CharCNN, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every finding of ``scan`` replaced by ``mark``; findings that overlap get one mark.

    Every row stays, with its other columns: null ids, repeated rows, and null texts, which stay null. A very long text is read as a
    whole; an empty table gives an empty one.
    """
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(at).to_pylist()
                new = [None if t is None else _cover(t, f, mark) for t, f in zip(texts, find(texts, model), strict=True)]
                cols = [pa.array(new, part.schema.field(at).type) if k == at else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


def _cover(text: str, spans: list[tuple], mark: str) -> str:
    parts, at = [], 0
    for s, e, *_ in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
