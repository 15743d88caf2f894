"""N-gram Jaccard join by chosen paths.

Each set of word n-grams samples tokens: a token is chosen if its hash lies below ``runs / (LAMBDA * size)``,
so one run gives 1/LAMBDA tokens a set in the mean and two sets of similarity LAMBDA or more share a chosen
one with probability 1 - 1/e at least. Runs repeat until the probability that a pair is missed in all of them is
below 1 - recall; as all runs share one hash, they are drawn at once. Sets that chose the same token form
a bucket. A bucket larger than ``SMALL`` is split on tokens sampled again, those that gave the places of the sketches
of its members, and so on until all are small; each time more tokens are sampled, so that all splits together lose a
bounded share of pairs, which the number of runs makes up for. A bucket that splitting does not shrink is a mass of
near copies and is compared tile by tile. Buckets and tiles are compared by brute force on their sketches.

Where the similar pairs of a bucket are few, each is kept; where they are many, their members are a group. Near copies meet
in all the buckets they chose, so one larger bucket of each set is compared, in parts, before all of them, which then tell only what
the groups found so far do not; a bucket inside one group is left out. Pairs and
groups are then verified with the whole n-gram sets: groups tile by tile, all their pairs counted once, other
pairs one by one, unless all that links reach is small enough to meet at once. Equal sets are one class from the start
and never expanded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import _contracted, connected_components, roots
from ..operators.skew import lookup, ranks
from ..session import Scratch, materialize
from ._words import U, buffers, grams, mix, slices, words

LAMBDA = 0.8
SKETCH = 128
#: Members of a bucket, and of a tile of a group, that one kernel compares at once; n-grams of a tile.
SMALL, TILE, TILE_GRAMS = 1024, 256, 1 << 21
#: Tokens that a set samples in the mean where a large bucket is split for the first time; one more each time after.
SPLIT = 3.0
#: Pairs a member from which what is similar in a bucket counts as one group.
DENSE = 4
#: Rows of at most some 50 bytes that may be broadcast.
BROADCAST_ROWS = 1 << 18


def gram_sets(texts: pa.Array, k: int):
    """Distinct k-grams of each text, ascending by hash, in slices: yields (first row, last row, hashes, firsts).

    A text of fewer than k words, but at least one, has the run of all its words as its only member.
    """
    b, offs = buffers(texts)
    for i, j in slices(offs):
        _, _, h, rows = words(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        n = np.diff(rows)
        g, firsts = grams(h, rows, k)
        row = np.repeat(np.arange(j - i), np.diff(firsts))
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            one = np.array([_whole(h[rows[r] : rows[r + 1]]) for r in short], U)
            g, row = np.concatenate([g, one]), np.concatenate([row, short])
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        yield i, j, g[new], np.searchsorted(row[new], np.arange(j - i + 1))


def _whole(h: np.ndarray) -> int:
    x = U(len(h))
    with np.errstate(over="ignore"):
        for v in h:
            x = x * U(0xD6E8FEB86659FD93) + v
    return int(mix(np.array([x], U), 99)[0])


def _sketches(g: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each set, empty places filled from others, eight bits a place."""
    n = len(firsts) - 1
    out = np.full((n, SKETCH), np.iinfo(np.uint64).max, U)
    row = np.repeat(np.arange(n), np.diff(firsts))
    x = mix(g, 1)
    place = (x & U(SKETCH - 1)).astype(np.int64)
    order = np.lexsort((x, place, row))
    key = row[order] * SKETCH + place[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out.ravel()[key[first]] = x[order][first]
    empty = out == np.iinfo(np.uint64).max
    some = np.diff(firsts) > 0
    todo = empty & some[:, None]
    step = 0
    while todo.any():
        step += 1
        r, c = np.nonzero(todo)
        src = (mix((c + SKETCH * step).astype(U), 2) % U(SKETCH)).astype(np.int64)
        ok = ~empty[r, src]
        out[r[ok], c[ok]] = out[r[ok], src[ok]]
        todo[r[ok], c[ok]] = False
        if step > 64 * SKETCH:
            break
    return ((out * U(0x9E3779B97F4A7C15)) >> U(56)).astype(np.uint8)


def _loose(n: np.ndarray, similarity: float) -> np.ndarray:
    """What two sketches must agree in for exact verification: four standard deviations below."""
    m = np.minimum(n, SKETCH) * 0.75
    return np.maximum(0.05, similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(m, 1)))


def _similar(s: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    out = np.zeros((len(s), len(s)), bool)
    lo = _loose(n, similarity)
    for i in range(0, len(s), 32):
        part = (s[i : i + 32, None, :] == s[None, :, :]).mean(2)
        ratio = np.minimum(n[i : i + 32, None], n) / np.maximum(n[i : i + 32, None], n)
        out[i : i + 32] = (part >= np.minimum(lo[i : i + 32, None], lo)) & (ratio >= similarity)
    return out


def pairs_and_groups(ok: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, dense)`` from a symmetric matrix of similar pairs: single pairs, or the stars of what is dense.

    ``group`` names the group that each is known to be in: pairs inside one are left out, and a star has one
    member of each group.
    """
    n = len(ok)
    i, j = np.nonzero(np.triu(ok, 1))
    if not len(i):
        return i, j, np.zeros(0, bool)
    root = roots(i, j, n)
    dense = np.bincount(root[i], minlength=n) > DENSE * np.bincount(root, minlength=n)
    single = ~dense[root[i]]
    hung = np.flatnonzero(dense[root] & (root != np.arange(n)))
    if group is not None:
        single &= group[i] != group[j]
        hung = hung[group[hung] != group[root[hung]]]
        hung = hung[np.unique(np.stack([root[hung], group[hung]], 1), axis=0, return_index=True)[1]]
    kind = np.repeat([False, True], [int(single.sum()), len(hung)])
    return np.concatenate([i[single], hung]), np.concatenate([j[single], root[hung]]), kind


def grouped(batches, column: int):
    """Whole runs of equal values of a column of 64-bit integers, many runs at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(column).to_numpy()
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if held and held[-1].column(column)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return first, np.append(first, len(k))[1:]


def _bytes2d(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _digests(g: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit sums of a set's members."""
    total = [np.zeros(n, U), np.zeros(n, U)]
    with np.errstate(over="ignore"):
        for t, seed in zip(total, (3, 4), strict=True):
            np.add.at(t, row, mix(g, seed))
    return total


def _kept(splits: int = 40) -> float:
    """Share of the pairs in a bucket that any number of splits keeps, at similarity LAMBDA."""
    return math.prod(1 - math.exp(-LAMBDA * (SPLIT + d)) for d in range(splits))


def similar_groups(df: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, n_links, copy_of)`` for every document.

    Documents link where the Jaccard similarity of their sets of n-grams of words is ``similarity`` or more; words are
    runs without ASCII white space, taken as they are. ``n_links`` counts the other documents linked with it, copies
    included; ``copy_of`` is the least id with an equal set; ``class_id`` the least id that links reach.

    A text of fewer than n words has one member, all its words; one without words, or null, has an empty set
    and links with nothing. Texts of any length are read whole. Rows that repeat an id and a set count once and each get the
    document's result; an id with several sets gets the least class of them and the sum of their links; rows
    without id are given back alone, with null class and no links. An empty table gives an empty one; further columns are not
    read, whatever their names. A pair of different sets stays unlinked with probability 1 - ``recall`` at
    most, and only where no chain of links joins it.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with Scratch() as s:
        sets, classes = _classes(s, rows, n, similarity, recall)
        member = sets.select("id", *KEY).distinct()
        per = lookup(member.filter("n > 0"), classes, KEY, "members", sets.count())
        per = per.groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"), F.min("rep").alias("copy_of"))
        known = sets.select("id").join(per, "id", "left")
        out = known.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_of", "id").alias("copy_of"))
        none = rows.filter("id is null").select("id", F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"))
        return s.result(out.union(none))


def keep_one(df: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each class of ``similar_groups``, all columns as they are.

    Rows are judged, not ids: what stays of a class is a row of its set of least id, and of rows that repeat that id and
    set one; rows of one id but unlike sets are judged apart. Rows without id and rows without words all
    stay. An empty table gives an empty one; texts of any length are read whole.
    """
    names = df.columns
    at = names.index(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with Scratch() as s:
        sets, classes = _classes(s, rows, n, similarity, recall)
        count = sets.filter("n > 0").groupBy("id", *KEY).agg(F.count("*").alias("times"))
        lead = classes.filter("lead").select(F.col("rep").alias("id"), *KEY, F.lit(True).alias("lead"))
        judged = count.join(lead, ["id", *KEY], "left")
        odd = judged.filter("lead is null or times > 1").select("id", *KEY, F.col("lead").isNotNull().alias("lead"))
        odd = materialize(odd)
    few = odd.count() <= BROADCAST_ROWS
    key = [f"_{c}" for c in ("id", *KEY)]
    odd = odd.toDF(*key, "_lead")

    def sign(batches):
        for b in batches:
            for i, j, g, firsts in gram_sets(b.column(at).cast(pa.string()), n):
                size = np.diff(firsts)
                d = _digests(g, np.repeat(np.arange(j - i), size), j - i)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in d)], [*names, *key[1:]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    signed = df.mapInArrow(sign, f"{kinds}, {', '.join(f'{k} long' for k in key[1:])}").withColumn("_id", F.col(id_col).cast("long"))
    known = signed.join(F.broadcast(odd) if few else odd, key, "left")
    once = known.filter(F.col("_lead").isNull())
    # a row that comes several times and leads its class
    first = known.filter("_lead").dropDuplicates(key)
    return once.unionByName(first).select(*[F.col(f"`{c}`") for c in names])


KEY = ["n", "d1", "d2"]


def _classes(s: Scratch, rows: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows with an id (id, *KEY), and their classes.

    A class is one distinct set: (*KEY, rep: least id, members: ids, class_id: least id that links reach, n_links, lead:
    whether it is the first of its component).
    """
    rate = math.ceil(math.log(1 / (1 - recall)) / _kept()) / LAMBDA

    def signatures(batches):
        for b in batches:
            for i, j, g, firsts in gram_sets(b.column(1), n):
                size = np.diff(firsts)
                row = np.repeat(np.arange(j - i), size)
                u = mix(g, 5).astype(np.float64) / 2.0**64
                chosen = u < rate / np.maximum(size, 1)[row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=j - i))])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(size.astype(np.int64)),
                        *(pa.array(t.view(np.int64)) for t in _digests(g, row, j - i)),
                        pa.array([x.tobytes() for x in _sketches(g, firsts)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g[chosen].view(np.int64))),
                    ],
                    ["id", *KEY, "sketch", "tokens"],
                )

    sets = s.table(rows.filter("id is not null").mapInArrow(signatures, "id long, n long, d1 long, d2 long, sketch binary, tokens array<long>"))
    found = sets.filter("n > 0").groupBy(*KEY).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("members"))
    # classes are numbered by least id, so that the least number of a component has its least id
    found = s.adopt(ranks(found, ["rep", "d1", "d2", "n"], "c"))
    lead = found.select("c", F.col("rep").alias("id"), *KEY)
    reps = sets.join(lead, ["id", *KEY]).dropDuplicates(["c"]).select("c", "n", "sketch", "tokens")
    reps = s.table(reps)
    edges = _edges(s, reps, similarity)
    exact = _verify(s, rows, edges, found, n, similarity)
    links = exact.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("weight").alias("linked"))
    comps = s.adopt(connected_components(exact.filter("b is not null"), "a", "b")).withColumnsRenamed({"vertex": "c", "component": "root"})
    out = found.join(links, "c", "left").join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))
    out = out.join(found.select(F.col("c").alias("root"), F.col("rep").alias("class_id")), "root")
    out = out.select(*KEY, "rep", "members", "class_id", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), (F.col("root") == F.col("c")).alias("lead"))
    return sets, s.table(out)


def _edges(s: Scratch, reps: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, dense)``: pairs whose sketches agree in a bucket they chose together, or what connects groups of such."""
    schema = "a long, b long, dense boolean"
    parts: list[DataFrame] = []

    def compare(batches):
        for t in grouped(batches, 0):
            yield from _brute(t, similarity)

    def splitter(tokens: float, depth: int):
        def split(batches):
            """Rows of a large bucket go to buckets of tokens that their sketches sample."""
            for b in batches:
                k = b.column(0).to_numpy()
                with np.errstate(over="ignore"):
                    place = _bytes2d(b.column(3), SKETCH).astype(U) * U(SKETCH) + np.arange(SKETCH, dtype=U)
                    token = mix(k.view(U)[:, None] * U(0x9E3779B97F4A7C15) + place, 6 + 2 * depth)
                r, c = np.nonzero(mix(token, 7 + 2 * depth).astype(np.float64) / 2.0**64 < tokens / SKETCH)
                yield pa.RecordBatch.from_arrays([pa.array(token[r, c].view(np.int64)), *(b.column(x).take(pa.array(r)) for x in (1, 2, 3, 4, 5))], ["bucket", "c", "n", "sketch", "g", "above"])

        return split

    def met(rows: DataFrame, total: int) -> DataFrame:
        """Rows whose bucket has two of them at least, not all of one group, with the number of its rows."""
        size = rows.groupBy("bucket").agg(F.count("*").alias("count"), (F.min("g") < F.max("g")).alias("mixed")).filter("mixed").drop("mixed")
        return lookup(rows, size.withColumn("weight", F.col("count")), ["bucket"], "weight", total)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, schema)

    def known(rows: DataFrame, edges: DataFrame) -> DataFrame:
        """``rows``, of which g names the group that dense ``edges`` connect c with."""
        dense = edges.filter("dense")
        few = dense.count() <= BROADCAST_ROWS
        if few:
            # one step of contraction holds all, and a root names itself
            groups = F.broadcast(s.table(_contracted(dense.select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(1))).toDF("c", "now"))
        else:
            groups = s.adopt(connected_components(dense, "a", "b")).toDF("c", "now")
        out = rows.join(groups, "c", "left").withColumn("g", F.coalesce("now", "g")).drop("now")
        return out if few else s.table(out)

    alone = F.lit(-1).alias("tile")
    picked = s.table(reps.select("c", F.explode("tokens").alias("bucket"), F.col("c").alias("g")))
    cur = s.table(met(picked, picked.count()).join(reps.select("c", "n", "sketch"), "c").select("bucket", "c", "n", "sketch", "g", "count", F.lit(1 << 62).alias("above")))
    parts, depth = [], 0
    many = cur.filter(F.col("count") > TILE)
    stored = cur
    if not many.isEmpty():
        # near copies agree in the least of their buckets
        first = many.groupBy("c").agg(F.min(F.struct("bucket", "n", "sketch", "g", "count")).alias("x")).select("c", "x.*")
        first = first.withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("c"), F.ceil(F.col("count") / SMALL))))
        parts.append(s.table(meet(first.select("bucket", "c", "n", "sketch", "g", alone))))
        cur = known(cur, parts[0])
    while True:
        small = F.col("count") <= SMALL
        # a bucket that has not halved holds near copies, which no further split parts
        mass = ~small & (2 * F.col("count") > F.col("above"))
        tiles = F.ceil(F.col("count") / (SMALL // 2)).cast("int")
        tiled = cur.filter(mass).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.withColumn("bucket", F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")))
        parts.append(s.table(meet(cur.filter(small).withColumn("tile", alone).select(*CELL).unionByName(tiled.select(*CELL)))))
        large = cur.filter(~small & ~mass)
        if large.isEmpty():
            break
        rows = large.select("bucket", "c", "n", "sketch", "g", F.col("count").alias("above"))
        rows = s.table(rows.mapInArrow(splitter(SPLIT + depth, depth), "bucket long, c long, n long, sketch binary, g long, above long"))
        s.drop(stored)
        cur = stored = s.table(met(rows, rows.count()))
        s.drop(rows)
        depth += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return s.table(out.distinct())


CELL = ["bucket", "c", "n", "sketch", "g", "tile"]


def _joined(ok: np.ndarray, tile: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Groups of a cell of two tiles, with what is dense inside each: the cells of single tiles tell that."""
    if (tile == tile[0]).all():
        return group
    i, j, dense = pairs_and_groups(ok & (tile[:, None] == tile))
    _, first, same = np.unique(group, return_index=True, return_inverse=True)
    at = np.arange(len(group))
    return roots(np.concatenate([at, i[dense]]), np.concatenate([first[same], j[dense]]), len(group))


def _brute(t: pa.Table, similarity: float):
    k, group, tile = (t[c].to_numpy() for c in ("bucket", "g", "tile"))
    ids, n = t["c"].to_numpy(), t["n"].to_numpy().astype(float)
    s = _bytes2d(t["sketch"], SKETCH)
    first, ends = runs(k)
    size = ends - first
    lo = _loose(n, similarity)
    a, b, dense = [], [], []
    # small buckets: all their pairs at once
    for m in range(2, 9):
        at = first[size == m]
        if len(at):
            x, y = np.triu_indices(m, 1)
            i, j = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
            for c in range(0, len(i), 1 << 15):
                p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                ok = (group[p] != group[q]) & (np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q])) & ((s[p] == s[q]).mean(1) >= np.minimum(lo[p], lo[q]))
                a.append(ids[p[ok]])
                b.append(ids[q[ok]])
                dense.append(np.zeros(int(ok.sum()), bool))
    for at, m in zip(first[size > 8], size[size > 8], strict=True):
        ok = _similar(s[at : at + m], n[at : at + m], similarity)
        i, j, d = pairs_and_groups(ok, _joined(ok, tile[at : at + m], group[at : at + m]))
        a.append(ids[at + i])
        b.append(ids[at + j])
        dense.append(d)
    if a:
        a, b, dense = np.concatenate(a), np.concatenate(b), np.concatenate(dense)
        keep = a != b
        rows = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep], dense[keep]], 1), axis=0)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(bool))], ["a", "b", "dense"])


def meetings(s: Scratch, edges: DataFrame, weights: DataFrame, tile: int, tile_weight: int) -> DataFrame:
    """``(c, cell, tile, other)``: where the ends of ``edges`` (a, b, dense) meet for verification.

    What edges connect meets in one cell if it is no more than a tile. Of the rest, groups that dense edges connect
    meet tile by tile, and other pairs each in a cell of its own; a pair inside a group is left to the group. ``weights`` is
    (c, weight); a tile has ``tile`` members and ``tile_weight`` of weight at most, unless a member alone has more.
    """

    def tiled(groups: DataFrame) -> DataFrame:
        size = groups.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("weight") / tile_weight)).cast("int").alias("tiles"), F.count("*").alias("size"))
        return lookup(groups, size, ["component"], "size", groups.count())

    comps = s.adopt(connected_components(edges, "a", "b"))
    every = s.table(tiled(s.table(comps.withColumnRenamed("vertex", "c").join(weights, "c"))))
    whole = every.filter("tiles = 1").select("c", "component", "tiles")
    large = every.filter("tiles > 1")
    if large.isEmpty():
        groups, pairs = whole, None
    else:
        some = s.table(edges.join(large.select(F.col("c").alias("a")), "a"))
        inner = s.adopt(connected_components(some.filter("dense"), "a", "b"))
        sized = tiled(s.table(inner.withColumnRenamed("vertex", "c").join(weights, "c")))
        # a group is not a component of all edges: its number is set apart
        groups = whole.unionByName(sized.select("c", (-F.col("component") - 1).alias("component"), "tiles"))
        of = inner.select("vertex", "component")
        pairs = some.filter("not dense").select("a", "b").distinct()
        pairs = pairs.join(of.toDF("a", "ga"), "a", "left").join(of.toDF("b", "gb"), "b", "left").filter("ga is null or gb is null or ga <> gb")
    # the tiles of a group: each member is sent to every pair of tiles that has its own
    mine = F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")
    cells = groups.withColumn("tile", mine).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("c", F.xxhash64("component", F.least("tile", "to"), F.greatest("tile", "to")).alias("cell"), "tile", (F.col("tile") == F.col("to")).alias("inner"))
    if pairs is not None:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.xxhash64(F.lit("pair"), "a", "b").alias("cell"), F.lit(0).alias("tile"), F.lit(True).alias("inner"))
        cells = cells.unionByName(ends)
    return s.table(cells)


def _verify(s: Scratch, rows: DataFrame, edges: DataFrame, found: DataFrame, n: int, similarity: float) -> DataFrame:
    """Exact links: ``(a, null, weight)`` adds links, ``(a, b, 0)`` connects linked classes."""
    cells = meetings(s, edges, found.select("c", F.col("n").alias("weight")), TILE, TILE_GRAMS)
    who = s.table(found.join(cells.select("c").distinct(), "c").select("rep", "c", *KEY, "members"))
    few = who.count() <= BROADCAST_ROWS
    texts = rows.join((F.broadcast(who) if few else who).withColumnRenamed("rep", "id"), "id").select("c", "text", *KEY, "members")

    def sets(batches):
        for b in batches:
            mine, d1, d2 = (b.column(c).to_numpy() for c in (2, 3, 4))
            for i, j, g, firsts in gram_sets(b.column(1), n):
                size = np.diff(firsts)
                e1, e2 = (x.view(np.int64) for x in _digests(g, np.repeat(np.arange(j - i), size), j - i))
                # an id may have other sets
                ok = np.flatnonzero((size == mine[i:j]) & (e1 == d1[i:j]) & (e2 == d2[i:j]))
                if len(ok):
                    at = pa.array(ok + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(5).take(at), pa.array([g[firsts[r] : firsts[r + 1]].tobytes() for r in ok], pa.binary())], ["c", "members", "grams"])

    full = texts.mapInArrow(sets, "c long, members long, grams binary")
    met = full.join(F.broadcast(cells) if few and cells.count() <= BROADCAST_ROWS else cells, "c").select("cell", "c", "members", "tile", "inner", "grams")

    def link(batches):
        for t in grouped(batches, 0):
            a, b, w = [], [], []
            for i, j in zip(*runs(t["cell"].to_numpy()), strict=True):
                _link(t.slice(i, j - i), similarity, a, b, w)
            yield from linked_rows(a, b, w)

    return s.table(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long, weight long"))


def linked_rows(a: list, b: list, w: list):
    """One batch of links; odd entries of the lists are weights, whose ``b`` is null, even ones connections."""
    if a:
        none = np.concatenate([np.full(len(x), k % 2 == 0) for k, x in enumerate(a)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b), pa.int64(), mask=none), pa.array(np.concatenate(w))], ["a", "b", "weight"])


def links_of(linked: np.ndarray, ids: np.ndarray, weight: np.ndarray, a: list, b: list, w: list) -> None:
    """Add what a symmetric matrix of links gives: weights of partners, and a star for each component."""
    total = linked @ weight
    some = np.flatnonzero(total)
    if not len(some):
        return
    i, j = np.nonzero(np.triu(linked, 1))
    root = roots(i, j, len(ids))
    other = np.flatnonzero(root != np.arange(len(ids)))
    a += [ids[some], ids[other]]
    b += [np.full(len(some), -1), ids[root[other]]]
    w += [total[some].astype(np.int64), np.zeros(len(other), np.int64)]


def _link(t: pa.Table, similarity: float, a: list, b: list, w: list) -> None:
    ids, first = np.unique(t["c"].to_numpy(), return_index=True)
    if len(ids) < 2:
        return
    t = t.take(pa.array(first))
    weight, tile, inner = t["members"].to_numpy(), t["tile"].to_numpy(), t["inner"].to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, U) for x in t["grams"].to_pylist()]
    n = np.array([len(x) for x in sets], float)
    if len(sets) == 2:
        common = np.array([[0.0, c := float(len(np.intersect1d(*sets, assume_unique=True)))], [c, 0.0]])
    else:
        common = _overlaps(sets)
    # intersection >= similarity * union; counts are whole numbers, so the margin only takes up rounding
    linked = common.astype(float) * (1 + similarity) >= similarity * (n[:, None] + n) - 1e-9
    np.fill_diagonal(linked, False)
    if not inner[0]:
        linked &= tile[:, None] != tile
    links_of(linked, ids, weight, a, b, w)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    many = np.bincount(col) > 1
    use = many[col]
    col, row = (np.cumsum(many) - 1)[col[use]], row[use]
    common = np.zeros((len(sets), len(sets)), np.float32)
    edge = np.searchsorted(col, np.arange(0, int(many.sum()) + 4096, 4096))
    for c, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[lo:hi], col[lo:hi] - 4096 * c] = 1
        common += m @ m.T
    return common
