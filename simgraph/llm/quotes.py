"""Chat formatting by quotation linking.

A message's lines that begin with ``>`` are quotes; the number of ``>`` is their level. Consecutive lines of one
level make a passage. Passages and own texts are normalised and hashed by units: of each ``SPAN`` neighbouring runs of
``RUN`` words the one of least hash, so that a passage, however trimmed or wrapped anew, has the units of the text it was
taken from; a passage too short for that is a unit as a whole, if it is all, a paragraph, a line or a sentence of the
original. A passage links its message with an earlier message that first said its units. Messages are then put into reply
order, thread by thread, replies behind what they answer, without quotes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup, ranks
from ..session import Scratch
from ._words import buffers, grams, sliding_min, words

_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
_WROTE = re.compile(r"^[ \t]*(on\b.*\bwrote|.*\bwrites|.*\bsaid)[ \t]*:[ \t]*$", re.I)
_GAPS = re.compile(r"[\W_]+")
_PARTS = re.compile(r"\n[ \t]*\n|\n|(?<=[.!?])\s+")
_PARAGRAPHS = re.compile(r"\n[ \t]*\n")
#: Words of a run, and neighbouring runs of which one is a unit.
RUN, SPAN = 4, 4
#: Words from which a passage has units inside.
LONG = RUN + SPAN - 1


#: What begins with as many words as a passage needs to have units inside.
_MANY = re.compile(rf"[\W_]*(?:[^\W_]+[\W_]+){{{LONG - 1}}}[^\W_]")


def normalise(passage: str) -> str:
    """Lower case, letters and digits only, one space between words."""
    return _GAPS.sub(" ", passage.lower()).strip()


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages with their levels, in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        now = m[1].count(">") if m else 0
        if m:
            if level == 0 and own and _WROTE.match(own[-1]):
                own.pop()
            if now != level or not passages:
                passages.append((now, []))
            passages[-1][1].append(m[2])
        else:
            own.append(line)
        level = now
    kept = "\n".join(own).strip("\n") if passages else text
    out = [(k, s) for k, lines in passages if (s := normalise("\n".join(lines)))]
    return kept, out


def _number(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def short_units(own: str) -> set[int]:
    """Numbers of the short parts of a text: all of it, its paragraphs, lines and sentences."""
    parts = {own, *_PARAGRAPHS.split(own), *own.split("\n"), *_PARTS.split(own)}
    return {_number(s) for s in {normalise(p) for p in parts if not _MANY.match(p)} if s and s.count(" ") < LONG - 1}


def run_units(texts: list[str]) -> list[set[int]]:
    """Numbers of the runs of words that stand for each normalised text; none for those of fewer than ``LONG`` words."""
    _, _, h, rows = words(*buffers(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())))
    g, firsts = grams(h, rows, RUN)
    if len(g) >= SPAN:
        row = np.repeat(np.arange(len(texts)), np.diff(firsts))
        least, ok = sliding_min(g, SPAN).view(np.int64), row[: len(g) - SPAN + 1] == row[SPAN - 1 :]
        row, least = row[: len(g) - SPAN + 1][ok], least[ok]
        order = np.lexsort((least, row))
        row, least = row[order], least[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
        row, least = row[new], least[new]
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        return [set(least[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return [set() for _ in texts]


def units_of(parsed: list[tuple[str, list[tuple[int, str]]]]) -> tuple[list[set[int]], list[list[tuple[int, set[int]]]]]:
    """Units of each message's own text, and of each of its passages with their levels."""
    flat = [s for _, q in parsed for _, s in q]
    runs = iter(run_units([normalise(o) for o, _ in parsed] + flat))
    own = [next(runs) | short_units(o) for o, _ in parsed]
    return own, [[(k, next(runs) or {_number(s)}) for k, s in q] for _, q in parsed]


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", share: float = 0.5) -> DataFrame:
    """``(conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread, depth, position)`` for every message.

    ``text`` has no quotes left. A passage is linked if ``share`` of its units were said before; its source is the
    latest of the turns that first said one of them. ``reply_to`` is the source of the outermost linked passage, the first on
    ties; ``thread`` the first turn of the chain of replies, ``depth`` the message's place in it, and
    ``position`` its place in the conversation's reply order: by thread, then turn, then role and text.

    A null text is empty; a null role stays; a text of any length is read whole. Rows without conversation or turn link with
    nothing, are their own thread and have a null position. Rows that repeat a turn each stay and quote for themselves; a
    quote of what one of them says links with that turn, and the turn's thread follows the least of their
    replies. An empty table gives an empty one; further columns are not read, whatever their names. No
    conversation, of any length, is one group in one task.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (conv, turn, role)}
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"conv_id {kinds[conv]}, turn {kinds[turn]}, role {kinds[role]}, text string, message long, says array<bigint>, quotes array<struct<level:int,units:array<bigint>>>"
    spec = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(pa.int64()))]))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                texts = b.column(3).slice(i, 512).to_pylist()
                parsed = [parse(t) for t in texts]
                own, quoted = units_of(parsed)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(i, 512) for c in range(3)),
                        pa.array([o for o, _ in parsed], pa.string()),
                        pa.array([_number(t) for t in texts], pa.int64()),
                        pa.array([sorted(u) for u in own], pa.list_(pa.int64())),
                        pa.array([[{"level": k, "units": sorted(u)} for k, u in q] for q in quoted], spec),
                    ],
                    ["conv_id", "turn", "role", "text", "message", "says", "quotes"],
                )

    with Scratch() as s:
        parsed = s.table(rows.mapInArrow(run, schema))
        known = parsed.filter("conv_id is not null and turn is not null")
        me = ["conv_id", "turn", "message"]
        quoted = known.filter(F.size("quotes") > 0).select(*me, F.posexplode("quotes").alias("place", "q")).distinct()
        quoted = s.table(quoted.select(*me, "place", "q.level", F.size("q.units").alias("n"), F.explode("q.units").alias("unit")))
        said = known.select("conv_id", "turn", F.explode("says").alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("first"))
        asked = quoted.groupBy("conv_id", "unit").agg(F.count("*").alias("weight"))
        hit = lookup(quoted, s.table(asked.join(said, ["conv_id", "unit"])), ["conv_id", "unit"], "weight", quoted.count())
        hit = hit.filter(F.col("first") < F.col("turn")).groupBy(*me, "place", "level", "n").agg(F.count("*").alias("found"), F.max("first").alias("source"))
        hit = hit.filter(F.col("found") >= share * F.col("n"))
        best = s.table(hit.groupBy(*me).agg(F.min_by("source", F.struct("level", "place")).alias("reply_to"), F.count("*").alias("n_linked")))
        up = best.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("thread")).withColumn("depth", F.lit(1))
        up = _climb(s, s.table(up))
        out = parsed.join(best, me, "left").join(up, ["conv_id", "turn"], "left")
        out = out.select(*me, "role", "text", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
        out = s.table(out)
        known = out.filter("conv_id is not null and turn is not null")
        ranked = s.adopt(ranks(known, ["conv_id", "thread", "turn", "role", "message"], "_rank"))
        first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first"), F.count("*").alias("weight"))
        placed = lookup(ranked, first, ["conv_id"], "weight", ranked.count()).withColumn("position", F.col("_rank") - F.col("_first"))
        rest = out.filter("conv_id is null or turn is null").withColumn("position", F.lit(None).cast("long"))
        cols = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread", "depth", "position"]
        return s.result(placed.select(*cols).unionByName(rest.select(*cols)))


def _climb(s: Scratch, up: DataFrame) -> DataFrame:
    """Follow replies to the first turn by doubling: each round replaces a step by two, so rounds are few however long chains are.

    A reply goes to an earlier turn, so chains end.
    """
    while True:
        asked = up.groupBy("conv_id", "thread").agg(F.count("*").alias("weight"))
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2")).join(asked, ["conv_id", "thread"])
        if above.isEmpty():
            return up
        nxt = lookup(up, above, ["conv_id", "thread"], "weight", up.count(), "left")
        up = s.table(nxt.select("conv_id", "turn", F.coalesce("t2", "thread").alias("thread"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))


def formatted(linked: DataFrame, template: str = "<|%s|>\n%s") -> DataFrame:
    """Adds the message as a chat turn; an unknown role is ``user``."""
    return linked.withColumn("formatted", F.format_string(template, F.coalesce("role", F.lit("user")), F.col("text")))


def conversations(linked: DataFrame, path: str) -> None:
    """Write messages in reply order: ranges of (conversation, position), each sorted; no key fills a task."""
    key = ["conv_id", "position"]
    formatted(linked).repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)


__all__ = ["conversations", "formatted", "link", "normalise", "parse"]
