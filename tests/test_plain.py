"""Operators that SQL cannot express, against plain versions on small inputs."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgraph.config import DedupeConfig
from simgraph.functions import raster
from simgraph.operators import cluster, dedupe, entities, graph, overlay, refine, simjoin, skew, views
from simgraph.plans.cascade import duplicate_groups
from simgraph.sources import layout, media, models


def blobs(seed, n=90, dim=8, loose=12):
    r = np.random.default_rng(seed)
    c = r.normal(size=(5, dim)) * 2
    x = np.concatenate([c[r.integers(0, 5, n)] + r.normal(0, 0.35, (n, dim)), r.normal(0, 2, (loose, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(spark, x, name="entity_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def plain_linkage(x, threshold):
    """All pairs of clusters, the nearest merged first."""
    parts = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(parts) > 1:
        far = [(np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j]
        best, i, j = min(far)
        if not best < threshold:
            break
        parts[i] += parts.pop(j)
    out = np.zeros(len(x), int)
    for k, p in enumerate(sorted(parts, key=min)):
        out[p] = k
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_average_linkage_equals_plain(seed):
    x = blobs(seed, 40, 5, 8)
    for t in (0.1, 0.3, 0.8):
        assert cluster.average_linkage(x, t).tolist() == plain_linkage(x, t).tolist()


def plain_split(x, label, threshold, above):
    sub = np.zeros(len(x), int)
    for c in set(label.tolist()) - {-1}:
        at = np.flatnonzero(label == c)
        if len(at) > above:
            sub[at] = plain_linkage(x[at], threshold)
    return sub


def test_split_and_relabel_equal_plain(spark):
    x = blobs(4)
    label = np.random.default_rng(4).integers(-1, 4, len(x))
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "entity_id long, cluster_id int, embedding array<double>")
    parts = cluster.split_large(df, 0.4, 20)
    sub = plain_split(x, label, 0.4, 20)
    assert {r.entity_id: r.sub for r in parts.collect()} == dict(enumerate(sub.tolist()))
    keys = {k: i for i, k in enumerate(sorted({(c, s) for c, s in zip(label.tolist(), sub.tolist(), strict=True) if c >= 0}))}
    assert {r.entity_id: r.cluster_id for r in cluster.relabel(parts).collect()} == {i: keys.get((c, s), -1) for i, (c, s) in enumerate(zip(label.tolist(), sub.tolist(), strict=True))}


def test_linkage_searches_little():
    # a chain of nearest neighbours takes a product with every row for each of its steps
    x = np.random.default_rng(5).normal(size=(3000, 32))
    seen, nearest = [], cluster.nearest
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cluster, "nearest", lambda a, own, b, *z: (seen.append(len(a) * len(b)), nearest(a, own, b, *z))[1])
        label = cluster.average_linkage(x, 0.7)
    assert 100 < label.max() < 2000 and sum(seen) < 4 * len(x) ** 2 and len(seen) < 200
    few = [0, 1, 0, 2, 1]
    odd = np.array([[1.0, 0.0], [0.0, 2.0], [3.0, 0.0], [np.nan, 1.0], [0.0, 1.0]])
    assert cluster.average_linkage(odd, 0.2).tolist() == few


@pytest.mark.parametrize("seed", [11, 12])
def test_spread_split_equals_plain(spark, monkeypatch, seed):
    x = np.concatenate([blobs(seed, 150), blobs(seed, 150)[:20], np.repeat(blobs(seed, 1, 8, 0), 15, 0), np.zeros((2, 8))])
    label = np.random.default_rng(seed).choice([-1, 3, 3, 3, 5, 5, 8], len(x))
    odd = [(len(x), 3, None), (len(x) + 1, 3, [float("nan")] * x.shape[1])]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))] + odd, "entity_id long, cluster_id int, embedding array<double>")
    monkeypatch.setattr(cluster, "SEARCH_TILE", 30)
    want = dict(enumerate(plain_split(x, label, 0.4, 40).tolist()))
    for most in (1 << 27, 400):  # all in one task a cluster, or larger searches by tiles
        monkeypatch.setattr(cluster, "SEARCH", most)
        got = cluster.split_large(df, 0.4, 40)
        assert got.dtypes == [("entity_id", "bigint"), ("cluster_id", "int"), ("sub", "int")]
        rows = {r.entity_id: r.sub for r in got.collect()}
        last = max(want[i] for i in want if label[i] == 3)
        assert (rows.pop(len(x)), rows.pop(len(x) + 1)) == (last + 1, last + 2) and rows == want


def plain_reach(x, k):
    d = np.clip(1 - x @ x.T, 0, 2)
    core = np.sort(d + np.diag(np.full(len(x), np.inf)), axis=1)[:, k - 1]
    return np.maximum(np.maximum(d, core[:, None]), core)


def test_spanning_tree_and_clusters_equal_plain(spark, monkeypatch):
    x = np.concatenate([blobs(5, 70), blobs(5, 70)[:6]])  # with copies
    reach = plain_reach(x, 2)
    monkeypatch.setattr(cluster.mutual_tree, "__defaults__", (25,))
    rows = vectors(spark, x).withColumnsRenamed({"entity_id": "id", "embedding": "v"})
    near = simjoin.topk_blocks(rows, 2, -2.0, "id", "v", block_rows=30)
    tree = cluster.mutual_tree(rows, near.groupBy(F.col("a").alias("id")).agg((1 - F.min("similarity")).alias("core"))).collect()
    best, done, total = reach[0].copy(), {0}, 0.0
    while len(done) < len(x):
        best[list(done)] = np.inf
        k = int(best.argmin())
        total += best[k]
        done.add(k)
        best = np.minimum(best, reach[k])
    assert len(tree) == len(x) - 1 and abs(sum(r.d for r in tree) - total) < 1e-9
    assert len(set(graph.roots(np.array([r.a for r in tree]), np.array([r.b for r in tree]), len(x)).tolist())) == 1
    got = {r.entity_id: r.cluster_id for r in cluster.hdbscan(vectors(spark, x), 6, 3).collect()}
    src, dst, dist = cluster.spanning_tree(x, np.sort((1 - x @ x.T) + np.diag(np.full(len(x), np.inf)), axis=1)[:, 1])
    want = cluster.hdbscan_labels(np.arange(len(x)), src, dst, dist, 6)
    pairs = {(got[i], int(want[i])) for i in range(len(x))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and len(pairs) > 2


def plain_refine(x, label, merge, noise, small_most, small, large, small_to_large, least, least_t, above, split):
    label = label.copy()

    def cents():
        ids = sorted(set(label.tolist()) - {-1})
        m = np.array([x[label == c].mean(0) for c in ids])
        return ids, m / np.linalg.norm(m, axis=1, keepdims=True)

    def absorb(t):
        ids, m = cents()
        for i in np.flatnonzero(label < 0):
            s = m @ x[i]
            if t is None or s.max() >= t:
                label[i] = ids[int(s.argmax())]

    def join(most, need):
        ids, m = cents()
        if len(ids) < 2:
            return
        s = m @ m.T - 3 * np.eye(len(ids))
        size = {c: int((label == c).sum()) for c in ids}
        for c in sorted((c for c in ids if size[c] <= most), key=lambda c: (-size[c], c)):
            k = int(s[ids.index(c)].argmax())
            if s[ids.index(c), k] >= need(size[ids[k]]):
                label[label == c] = ids[k]

    ids, m = cents()
    near = m @ m.T >= merge
    root = graph.roots(*np.nonzero(np.triu(near, 1)), len(ids))
    new = {ids[i]: k for k, rt in enumerate(sorted(set(root.tolist()))) for i in np.flatnonzero(root == rt)}
    label = np.array([new.get(c, -1) for c in label.tolist()])
    absorb(noise)
    join(small_most, lambda n: max(small, small_to_large) if n >= large else small)
    join(least - 1, lambda n: least_t)
    sub, top, fresh = plain_split(x, label, split, above), int(label.max()), {}
    for c in sorted(set(label.tolist()) - {-1}):
        if sub[label == c].any():
            fresh |= {(c, k): None for k in sorted(set(sub[label == c].tolist()))}
    fresh = {k: top + 1 + i for i, k in enumerate(fresh)}
    label = np.array([fresh.get((c, s), c) for c, s in zip(label.tolist(), sub.tolist(), strict=True)])
    join(1, lambda n: -2.0)
    absorb(None)
    return label


def test_refine_equals_plain(spark, seed=6):
    x = blobs(seed, 110)
    r = np.random.default_rng(seed)
    label = np.where(r.random(len(x)) < 0.15, -1, np.where(r.random(len(x)) < 0.1, 20 + np.arange(len(x)) // 2, r.integers(0, 9, len(x))))
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "entity_id long, cluster_id int, embedding array<double>")
    args = (0.9, 0.5, 4, 0.3, 30, 0.6, 4, 0.1, 25, 0.6)
    got = {q.entity_id: q.cluster_id for q in refine.refine(df, *args).collect()}
    assert got == dict(enumerate(plain_refine(x, label, *args).tolist()))


def test_topk_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.concatenate([blobs(8, 120), np.repeat(blobs(8, 1, 8, 0), 40, 0), np.zeros((2, 8))])
    odd = [(900, None), (901, [float("nan")] * 8), (902, [None] * 8)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<double>")
    monkeypatch.setattr(simjoin, "VISITORS", 50)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    s = (x / np.where(n > 0, n, 1)) @ (x / np.where(n > 0, n, 1)).T
    for k, floor in ((3, 0.8), (4, -2.0)):
        got = {}
        for q in simjoin.topk_blocks(df, k, floor, block_rows=16).collect():
            got.setdefault(q.a, []).append((round(q.similarity, 9), q.b))
        assert not set(got) - set(range(len(x)))
        for i in r.permutation(len(x))[:60].tolist() + [len(x) - 1]:
            want = sorted(((-round(s[i, j], 9), j) for j in range(len(x)) if j != i and s[i, j] >= floor))[:k]
            assert sorted((-a, b) for a, b in got.get(i, [])) == want, i


def test_verdicts_over_frames(spark):
    """Ten frames of which one matches are no duplicate; each kind of hash has its own threshold."""
    r = np.random.default_rng(9)
    new = lambda: int(r.integers(0, 1 << 62))
    frames = [(a, i, f"{new():016x}", f"{new():016x}") for a in ("a", "b", "c") for i in range(10)]
    frames[10] = ("b", 0, frames[0][2], frames[10][3])  # one match of a and b
    frames += [("d", i, f"{int(frames[20 + i][2], 16) ^ 1:016x}", f"{new():016x}") for i in range(9)]  # near c by the first hash
    frames += [("e", 0, f"{new():016x}", frames[25][3]), ("f", 0, f"{new():016x}", f"{int(frames[27][3], 16) ^ 3:016x}")]
    frames += [("g", i, *frames[i][2:]) for i in range(10)]  # a copy of a
    df = spark.createDataFrame(frames, "asset_id string, frame_index int, ahash string, phash string")
    limit = {"ahash": 1, "phash": 1}
    by = {}
    for a, _, h, p in frames:
        by.setdefault(a, []).append((int(h, 16), int(p, 16)))
    same = lambda x, y: (x[0] ^ y[0]).bit_count() <= limit["ahash"] or (x[1] ^ y[1]).bit_count() <= limit["phash"]
    want = {}
    for a in by:
        for b in by:
            if a < b and (m := sum(any(same(x, y) for y in by[b]) for x in by[a])):
                least = min(len(by[a]), len(by[b]))
                want[a, b] = (m, least == 1 or m / least >= 0.8)
    got = {(x.a, x.b): (x.matched, x.is_duplicate) for x in dedupe.pair_verdict(df, ["ahash", "phash"], limit, 0.8).collect()}
    assert got == {k: v for k, v in want.items() if "g" not in k or k == ("a", "g")}
    assert not got["a", "b"][1] and got["a", "g"][1] and got["c", "d"][1] and got["c", "e"][1] and ("c", "f") not in got
    index = spark.createDataFrame([(a, "video", f"/{a}", 1, 1, 1, 1, 1.0, a) for a in by], "asset_id string, type string, path string, size long, mtime long, width int, height int, duration double, sha256 string")
    cfg = DedupeConfig(ahash_threshold=1, phash_threshold=1)
    groups = {}
    for x in duplicate_groups(index, df, ["ahash", "phash"], cfg).collect():
        groups.setdefault(x.group_id, set()).add(x.asset_id)
    assert sorted(map(sorted, groups.values())) == [["a", "g"], ["c", "d", "e"]]


def test_greedy_match_equals_plain(spark):
    r = np.random.default_rng(10)
    box = lambda: (float(x := r.integers(0, 40)), float(y := r.integers(0, 40)), float(x + r.integers(8, 30)), float(y + r.integers(8, 30)))
    tracks = [(f, t, *box()) for f in range(6) for t in range(5)]
    dets = [(f, f * 10 + d, *box()) for f in range(6) for d in range(6)]
    got = {(x.frame, x.track_id): x.det_id for x in entities.greedy_match(spark.createDataFrame(tracks, "frame int, track_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(dets, "frame int, det_id long, x1 double, y1 double, x2 double, y2 double"), ["frame"], 0.2).collect()}
    want = {}
    for f in range(6):
        used = set()
        for _, t, *b in (x for x in tracks if x[0] == f):
            o = [(-entities.Tracker.overlaps(np.array([b]), np.array([c]))[0, 0], d) for _, d, *c in (x for x in dets if x[0] == f) if d not in used]
            if o and min(o)[0] < -0.2:
                want[f, t] = min(o)[1]
                used.add(min(o)[1])
    assert got == want and len(want) > 10


def test_tracks_are_assigned_at_least_cost():
    from itertools import permutations

    r = np.random.default_rng(14)
    for _ in range(200):
        n, m = map(int, r.integers(0, 5, 2))
        cost, limit = r.random((n, m)), 0.6
        got = entities._assign(cost, limit)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(cost[i, j] <= limit for i, j in got)
        # a row without partner costs the limit twice, as its match would have saved both sides theirs
        price = lambda pairs: sum(cost[i, j] for i, j in pairs) + limit * (n + m - 2 * len(pairs))  # noqa: B023, E731
        every = ([(i, j) for i, j in zip(range(n), p, strict=True) if j < m and cost[i, j] <= limit] for p in permutations(range(m + n), n))
        assert abs(price(got) - min(map(price, every), default=0.0)) < 1e-9


def test_projection_equals_plain(spark):
    x = np.random.default_rng(11).normal(size=(30, 6)) * [5, 3, 1, 1, 1, 1]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cluster_id int, centroid array<double>")
    got = np.array([(r.x, r.y) for r in sorted(views.projection(c).collect(), key=lambda r: r.cluster_id)])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    load = v[:2].T * np.sign(v[:2].T[np.abs(v[:2].T).argmax(0), [0, 1]])
    p = x @ load
    assert np.allclose(got, (p - p.min(0)) / (p.max(0) - p.min(0)), atol=1e-6)
    assert [tuple(r) for r in views.projection(c.limit(1)).collect()] == [(0, 0.5, 0.5)]


def test_lookups_and_numbers(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 500 + [None] * 5 + list(range(20)))], "k int, i int")
    table = spark.createDataFrame([(k, 500 if k == 7 else 1, f"v{k}") for k in range(5, 12)], "k int, n int, v string")
    got = skew.lookup(rows, table, ["k"], "n", 525, "left").collect()
    assert len(got) == 525 and all(r.v == (f"v{r.k}" if r.k is not None and 5 <= r.k < 12 else None) for r in got)
    assert skew.lookup(rows, table, ["k"], "n", 525).count() == 507
    r = np.random.default_rng(12).permutation(300).tolist()
    got = sorted((x.place, x.a, x.b) for x in skew.ranks(spark.createDataFrame([(v % 7, v) for v in r], "a int, b int"), ["a", "b"], "place").collect())
    assert [x[0] for x in got] == list(range(300)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_places_in_large_groups(spark, monkeypatch):
    df = spark.createDataFrame([(k % 3 if k < 60 else 9, (k * 7) % 50, k) for k in range(200)], "g int, x int, id int")
    order = [F.desc("x"), "id"]
    want = sorted(map(tuple, skew.rank_within(df, "g", order).select("g", "x", "id", "rank").collect()))
    monkeypatch.setattr(skew, "LARGE", 10)
    assert sorted(map(tuple, skew.rank_within(df, "g", order).select("g", "x", "id", "rank").collect())) == want


def test_sources_know_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 21, 31) + b"\0" * 9
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 32, -22)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (32).to_bytes(3, "little") + (22).to_bytes(3, "little")
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 34, 0) + struct.pack("<HHII", 257, 4, 1, 24)
    df = spark.createDataFrame([(i, c) for i, c in enumerate([png, jpg, bmp, webp, tiff, b"nothing", png[:20], None])], "i int, content binary")
    got = [(r.width, r.height) for r in sorted(media.image_sizes(df).collect(), key=lambda r: r.i)]
    assert got == [(30, 20), (31, 21), (32, 22), (33, 23), (34, 24), (None, None), (None, None), (None, None)]
    with pytest.raises(Exception, match="ZeroDivision"):
        media.probe(spark.createDataFrame([("x",)], "path string"), lambda p: 1 / 0).collect()
    assert media.probe(spark.createDataFrame([("/none.mp4",)], "path string"), media.ffprobe).first().width is None
    media.write_json(spark.createDataFrame([("k1", [1, 2]), ("k2", [])], "asset_id string, v array<int>"), str(tmp_path / "j"), "asset_id")
    back = spark.read.schema("asset_id string, v array<int>").option("recursiveFileLookup", "true").json(str(tmp_path / "j"))
    assert sorted((r.asset_id, list(r.v)) for r in back.collect()) == [("k1", [1, 2]), ("k2", [])]
    assert media.read_json(spark, str(tmp_path / "j" / "_key=k1"), "asset_id string, v array<int>").first().asset_id == "k1"
    index = spark.createDataFrame([("a", "/x/a.jpg"), ("b", "/x/b.mp4")], "asset_id string, path string")
    assert media.path_of(index, "b").first().path == "/x/b.mp4" and media.path_of(index, "z").isEmpty()
    place = layout.Layout(str(tmp_path / "lib"))
    assert place.read(spark, "groups").count() == 0
    place.write(spark.createDataFrame([(5, "a"), (5, "b")], "group_id int, asset_id string"), "groups")
    assert sorted(map(tuple, place.refresh(spark, "groups")["groups"].collect())) == [("a", 5), ("b", 5)]


def test_models_see_crops(spark):
    r = np.random.default_rng(13)
    img = r.integers(0, 255, (3, 40, 50, 3), dtype=np.uint8)
    rasters = spark.createDataFrame([("a", k, 40, 50, img[k].tobytes()) for k in range(3)], "asset_id string, frame_index int, height int, width int, pixels binary")

    class Persons:
        def detect(self, images):
            return [[models.Found((5, 6, 25, 36), 0.9), models.Found((-5, -5, 4, 4), 0.5), models.Found((0, 0, 5, 5), 0.1)] for _ in images]

    class Faces:
        def detect(self, images):
            return [[models.Found((1, 1, 6, 6), 0.8, [float(i.mean()), 1.0]), models.Found((0, 0, 1, 1), 0.3)] for i in images]

    class Mean:
        def embed(self, images):
            return np.array([[np.frombuffer(b, np.float32).mean(), 1.0] for b in images])

    persons = models.detect_persons(rasters, Persons)
    assert sorted((p.source, p.det_id, p.x1) for p in persons.collect()) == [(k, d, x) for k in range(3) for d, x in ((0, 5.0), (1, -5.0))]
    faces = models.detect_faces(rasters, persons, Faces).collect()
    assert len(faces) == 6 and {(f.x1, f.y1, f.x2, f.y2) for f in faces if f.det_id == 0} == {(6.0, 7.0, 11.0, 12.0)}
    assert all(abs(f.embedding[0] - img[f.source][6:36, 5:25].mean()) < 1e-9 for f in faces if f.det_id == 0)
    body = models.embed_crops(rasters, persons.filter("det_id = 0").withColumn("entity_id", F.lit("e")), Mean, "body", raster.body_input).first()
    assert body.id == "e" and body.modality == "body" and abs(np.linalg.norm(body.embedding) - 1) < 1e-9
    frames = spark.createDataFrame([(a, k, f"{a}{k}".encode()) for a in "xyz" for k in range(2)], "asset_id string, frame_index int, content binary")
    cached = spark.createDataFrame([("x", 0, [3.0, 4.0])], "asset_id string, frame_index int, embedding array<double>")
    out = models.dense_embeddings(spark.createDataFrame([("x",), ("y",), ("y",)], "asset_id string"), cached, frames, models.StubEmbedder).collect()
    assert sorted((q.asset_id, q.frame_index) for q in out) == [("x", 0), ("y", 0), ("y", 1)]
    assert raster.crop(img[0], (-3, 2.7, 4.9, 9)).shape == (7, 4, 3) and raster.crop(img[0], (60, 0, 70, 9)).size == 0
    flat = np.full((10, 8, 3), 100, np.uint8)
    assert np.allclose(raster.encoder_input(flat)[0], (100 / 255 - raster.MEAN[0]) / raster.SPREAD[0]) and raster.body_input(flat).shape == (3, 256, 128)
    ramp = np.arange(4.0)[None, :, None].repeat(3, 2).repeat(4, 0)
    assert np.allclose(raster.bilinear(ramp, 4, 8)[0, :, 0], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])
    h = rasters.select(raster.raster_hashes("height", "width", "pixels").alias("h"), "frame_index").collect()
    assert all(q.h.asDict() == raster.hash_image(img[q.frame_index]) for q in h)


def test_edits_are_refused_or_logged(spark, tmp_path):
    g = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, -1)], "entity_id long, cluster_id int")
    now = lambda d: {r.entity_id: r.cluster_id for r in d.collect()}
    assert now(overlay.edit_clusters(g, "merge_selected", cluster_ids=[1, 2])) == {1: 3, 2: 3, 3: 3, 4: -1}
    assert now(overlay.edit_clusters(g, "split_cluster", entity_ids=[3], source=2)) == {1: 1, 2: 2, 3: 3, 4: -1}
    assert now(overlay.edit_clusters(g, "merge_clusters", source=2, target=1)) == {1: 1, 2: 1, 3: 1, 4: -1}
    assert now(overlay.edit_clusters(g, "move_entities", entity_ids=[4], target=1)) == {1: 1, 2: 2, 3: 2, 4: 1}
    for bad in ({"action": "explode"}, {"action": "merge_selected", "cluster_ids": [1]}, {"action": "move_entities", "entity_ids": [1]}):
        with pytest.raises(ValueError):
            overlay.edit_clusters(g, **bad)
    with pytest.raises(KeyError):
        views.group_members(g.toDF("asset_id", "group_id"), g, 99)
    h, log = overlay.History(), overlay.OverrideLog(spark, str(tmp_path / "o"), "asset_id long, group_id int")
    base = g.toDF("asset_id", "group_id")
    for edit in (lambda d: overlay.move(d, [1], 7), lambda d: overlay.move(d, [2], 8)):
        cur = h.version
        state = overlay.overlay_known(base, log.read(cur).withColumn("seq", F.lit(1)), "asset_id")
        log.append(cur, overlay.changes(state, edit(state)), h.edit())
    at = lambda v: {r.asset_id: r.group_id for r in log.read(v).collect()}
    assert at(h.version) == {1: 7, 2: 8} and at(h.undo()) == {1: 7} and at(h.undo()) == {} and at(h.redo()) == {1: 7}


def test_windows_are_sampled(spark, tmp_path):
    from simgraph.streaming.incremental import sample_windows

    spark.createDataFrame([("a", t, t) for t in (0, 3, 11, 12, 60)] + [("b", 5, 9), ("b", 90, 90)], "k string, t long, v long").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, t long, v long").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    q = sample_windows(s, "ts", "10 seconds", "1 second", "k", "v").writeStream.outputMode("append").format("memory").queryName("sampled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert sorted((r.k, r.v) for r in spark.sql("select * from sampled").collect()) == [("a", 0), ("a", 11), ("a", 60), ("b", 9)]
