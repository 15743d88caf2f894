"""Cases of the operators that no table shows."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgraph.config import DedupeConfig, from_json, pick_stages
from simgraph.functions import bbox, hash, raster
from simgraph.operators import align, cluster, dedupe, entities, graph, overlay, refine, simjoin
from simgraph.operators.graph import connected_components


def test_band_slices_cover_the_hash():
    text = "0123456789abcdef"
    assert [text[s : s + n] for s, n in hash.band_slices(3)] == ["012345", "6789a", "bcdef"]
    assert "".join(text[s : s + n] for s, n in hash.band_slices(5)) == text


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = spark.range(1).select(
        bbox.iou(b(0, 0, 10, 10), b(5, 5, 15, 15)).alias("iou"),
        bbox.clamp_padded(b(10, 10, 30, 30), F.lit(100.0), F.lit(100.0), 0.1).alias("pad"),
        bbox.clamp(b(-10, -5, 5, 10), F.lit(100.0), F.lit(100.0)).alias("cut"),
        bbox.clamp(b(5, 5, 5, 9), F.lit(100.0), F.lit(100.0)).alias("none"),
    ).first()
    assert abs(r.iou - 25 / 175) < 1e-12
    assert tuple(r.pad) == (8, 8, 32, 32)
    assert tuple(r.cut) == (0, 0, 5, 10)
    assert r.none is None


@pytest.mark.parametrize("n,m,offset,size", [(10, 10, 0, 10), (20, 10, -4, 10), (10, 20, 3, 10), (30, 25, 10, 6)])
def test_alignment_finds_planted_diagonals(spark, n, m, offset, size):
    r = np.random.default_rng(1)
    a, b = np.eye(64)[r.permutation(64)[:n]], np.eye(64)[r.permutation(64)[:m]]
    b = -np.abs(r.normal(size=(m, 64)))
    i0 = max(0, -offset)
    for k in range(min(size, n - i0, m - i0 - offset)):
        b[i0 + k + offset] = a[i0 + k]
    f = [("a", i, v.tolist()) for i, v in enumerate(a)] + [("b", i, v.tolist()) for i, v in enumerate(b)]
    frames = spark.createDataFrame(f, "asset_id string, frame_index int, embedding array<double>")
    out = align.diagonal_overlap(spark.createDataFrame([("a", "b")], "a string, b string"), frames, 0.8).first()
    assert (out.offset, out.match_count) == (offset, min(size, n - i0, m - i0 - offset))


def test_alignment_without_match(spark):
    frames = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0])], "asset_id string, frame_index int, embedding array<double>")
    out = align.diagonal_overlap(spark.createDataFrame([("a", "b")], "a string, b string"), frames, 0.8).first()
    assert out.offset is None and out.match_count == 0 and out.overlap_ratio == 0


def test_banded_join_loses_no_pair(spark):
    r = np.random.default_rng(0)
    base = [int(x) for x in r.integers(0, 1 << 63, 40)]
    near = [base[0] ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for k in (0, 1, 2, 3) for _ in range(3)]
    h = [(i, f"{v:016x}") for i, v in enumerate(base + near)]
    df = spark.createDataFrame(h, "asset_id long, phash string")
    got = {(x.a, x.b) for x in dedupe.hamming_pairs(df, ["phash"], 2, expand=True).collect()}
    want = {(i, j) for i, a in h for j, b in h if i < j and (int(a, 16) ^ int(b, 16)).bit_count() <= 2}
    assert got == want and want
    lead = {v: min(i for i, w in h if w == v) for _, v in h}
    few = {(x.a, x.b) for x in dedupe.hamming_pairs(df, ["phash"], 2).collect()}
    assert few == {(i, j) for i, j in want if lead[dict(h)[i]] == i and (lead[dict(h)[j]] in (i, j))}


def test_wide_thresholds_use_bits(spark):
    h = spark.createDataFrame([(1, "0" * 16), (2, "f" * 4 + "0" * 12), (3, "f" * 16)], "asset_id long, phash string")
    assert {(x.a, x.b) for x in dedupe.hamming_pairs(h, ["phash"], 16).collect()} == {(1, 2)}


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (500, 500)] + [(200, x) for x in range(201, 260)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[500] == 500 and got[259] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def chains(kind):
    """Chains, a hub and loops in no order, and the least vertex of each."""
    e = [(c * 1000 + i, c * 1000 + i + 1) for c in range(1, 6) for i in range(150)] + [(9000, 9000 + i) for i in range(1, 80)] + [(8000, 8000), (1003, 1003)]
    e = [e[i] for i in np.random.default_rng(3).permutation(len(e))]
    name = (lambda x: f"v{x}") if kind == "string" else int
    return [(name(a), name(b)) for a, b in e], {name(x): name(x // 1000 * 1000) for p in e for x in p}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("chunk", [graph.CHUNK, 16])
def test_components_of_one_chunk_take_no_round(spark, monkeypatch, kind, chunk):
    rounds = []
    large = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda *a: (rounds.append(1), large(*a))[1])
    monkeypatch.setattr(graph, "CHUNK", chunk)
    e, want = chains(kind)
    out = connected_components(spark.createDataFrame(e, f"src {kind}, dst {kind}").repartition(16))
    rows = out.collect()
    assert {r.vertex: r.component for r in rows} == want and len(rows) == len(want)
    assert [t for _, t in out.dtypes] == [kind if kind != "long" else "bigint"] * 2
    # more than a chunk still goes round by round
    assert bool(rounds) == (chunk == 16)


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99], [-1, 0]], float)
    assert cluster.average_linkage(x, 0.2).tolist() == [0, 0, 1, 1, 2]
    assert cluster.average_linkage(x[:1], 0.2).tolist() == [0]


def test_density_clusters(spark):
    r = np.random.default_rng(2)
    rows = [(i, (c + r.normal(0, 0.02, 8)).tolist()) for i, c in enumerate(np.repeat(np.eye(8)[:3], 20, 0))] + [(60 + i, r.normal(size=8).tolist()) for i in range(5)]
    got = {x.entity_id: x.cluster_id for x in cluster.hdbscan(spark.createDataFrame(rows, "entity_id long, embedding array<double>"), 5, 3).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {1} and {got[i] for i in range(40, 60)} == {2}


def plain_fold(decisions):
    """Moves made one after another, each on every label that then equals its source."""
    now = {c: c for c, _, _ in decisions}
    for c, t, _ in sorted(decisions, key=lambda d: (-d[2], d[0])):
        now = {k: t if v == c else v for k, v in now.items()}
    return now


@pytest.mark.parametrize("seed", [0, 1])
def test_moves_are_followed_in_order(spark, seed):
    r = np.random.default_rng(seed)
    d = [(c, int(t), int(r.integers(1, 5))) for c, t in enumerate(r.integers(0, 40, 30)) if c != t]
    d += [(100, 101, 3), (101, 102, 2), (102, 103, 1), (103, 100, 1)]
    got = {x.cluster_id: x.new_id for x in refine.followed(spark.createDataFrame(d, "cluster_id long, target long, size long")).collect()}
    assert got == plain_fold(d)


def test_history():
    h = overlay.History()
    with pytest.raises(ValueError):
        h.undo()
    a = h.edit()
    b = h.edit()
    assert h.undo() == a and h.redo() == b
    h.undo()
    c = h.edit()
    assert c not in (a, b) and h.undo() == a
    with pytest.raises(ValueError):
        overlay.merge_groups(None, None, [3])


def test_directed_topk_goes_by_tiles_beyond_few_vectors(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(150, 8)))] + [(150, [0.0] * 8), (151, None), (152, [float("nan")] * 8), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "id int, embedding array<double>")
    want = simjoin.topk_directed(v, 3, 0.1)
    monkeypatch.setattr(simjoin, "DIRECT", 100)
    got = simjoin.topk_directed(v, 3, 0.1)
    near = lambda df: sorted((x.a, x.b, round(x.similarity, 9)) for x in df.collect())
    assert near(got) == near(want) and got.dtypes == want.dtypes
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_topk_blocks_equal_expressions(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(120)], "id long, embedding array<double>")
    a = sorted((x.a, x.b, round(x.similarity, 9)) for x in simjoin.topk_directed(v, 3, 0.1).collect())
    b = sorted((x.a, x.b, round(x.similarity, 9)) for x in simjoin.topk_blocks(v, 3, 0.1, block_rows=50).collect())
    assert a == b and a


def test_tracker_follows_a_box(spark):
    rows = [("x", f, f * 10 + k, 10.0 * k * 5 + 2 * f, 10.0, 10.0 * k * 5 + 2 * f + 30, 60.0, 0.9) for f in range(12) for k in (0, 2)]
    d = spark.createDataFrame(rows, "asset_id string, source int, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = entities.track(d).groupBy("track_id").agg(F.count("*").alias("n"), F.count_distinct(F.col("det_id") % 10).alias("k")).collect()
    assert sorted((r.n, r.k) for r in got) == [(12, 1), (12, 1)]


def test_image_hashes():
    x = np.linspace(0, 255, 256)
    grad = np.stack([np.tile(x, (256, 1)), np.tile(x, (256, 1)).T, (np.tile(x, (256, 1)) + np.tile(x, (256, 1)).T) / 2], -1).astype(np.uint8)
    board = np.kron(np.indices((16, 16)).sum(0) % 2 * 255, np.ones((16, 16)))[..., None].repeat(3, -1)
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    a, s, c = raster.hash_image(grad), raster.hash_image(np.rint(raster.resize(grad, 128, 128))), raster.hash_image(board)
    assert all(far(a[k], s[k]) <= 4 for k in ("ahash", "dhash")) and all(far(a[k], c[k]) > 8 for k in a)
    # the DCT hash of a plain gradient is rounding noise; a textured image keeps it
    tex = np.rint(raster.resize(np.random.default_rng(4).uniform(0, 255, (12, 12, 3)), 256, 256))
    assert far(raster.hash_image(tex)["phash"], raster.hash_image(np.rint(raster.resize(tex, 128, 128)))["phash"]) <= 4


def test_config():
    assert DedupeConfig().resolve_threshold == 0.98
    assert from_json(DedupeConfig, '{"top_k": 9}').top_k == 9
    with pytest.raises(ValueError):
        from_json(DedupeConfig, '{"nope": 1}')
    assert pick_stages(["1", "a"], ["a", "b", "c"]) == ["a", "b"]


def test_sources_and_streaming(spark, tmp_path):
    from simgraph.sources import media, models
    from simgraph.streaming.incremental import first_of_content, run_incremental

    (tmp_path / "m").mkdir()
    for n, c in (("a.JPG", b"1"), ("b.mp4", b"22"), ("c.txt", b"3"), ("d.jpg", b"1")):
        (tmp_path / "m" / n).write_bytes(c)
    np.save(tmp_path / "m" / "v1.npy", np.arange(3.0))
    found = media.scan_media(spark, str(tmp_path / "m"))
    assert sorted((r.type, r["size"]) for r in found.collect()) == [("image", 1), ("image", 1), ("video", 2)]
    assert dedupe.exact_groups(found).count() == 2
    assert [list(r.embedding) for r in media.read_vectors(spark, str(tmp_path / "m")).collect()] == [[0.0, 1.0, 2.0]]
    assert media.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    p = media.probe(found.select("path"), lambda x: {"width": 4, "height": 2, "fps_num": 30.0, "fps_den": 0.0, "format_duration": 1.5} if x.endswith("mp4") else {"width": int("no number")})
    r = p.filter("width is not null").first()
    assert r.fps is None and r.duration == 1.5 and p.filter("width is null").count() == 2
    img = spark.createDataFrame([("1", b"x"), ("2", b"y")], "id string, content binary")
    assert models.embed(img, models.StubEmbedder, "clip").count() == 2

    spark.createDataFrame([("a", 1), ("b", 2)], "asset_id string, x int").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema("asset_id string, x int").parquet(str(tmp_path / "in"))
        run_incremental(s, lambda d: d.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    s = spark.readStream.schema("asset_id string, x int").parquet(str(tmp_path / "in")).withColumns({"ts": F.timestamp_seconds(F.col("x")), "sha256": F.lit("h")})
    q = first_of_content(s, "ts", "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp9")).start()
    q.awaitTermination(60)
    assert spark.sql("select * from firsts").count() == 1


def test_stream_tracker_equals_batch(spark, tmp_path):
    from simgraph.streaming.tracker import track_stream

    rows = [("x", f, f * 10 + k, 50.0 * k + 2 * f, 10.0, 50.0 * k + 2 * f + 30, 60.0, 0.9) for f in range(8) for k in (0, 2)]
    kind = "asset_id string, source int, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one state store is enough
    for half in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 4 == half], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = track_stream(s).writeStream.foreachBatch(lambda d, i: d.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
        # a query with timeouts never runs out of batches: it is stopped once its rows are through
        for _ in range(240):
            if any(p.numInputRows for p in q.recentProgress):
                break
            time.sleep(0.5)
        q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.source, r.track_id) for r in got.collect()) == sorted((f, t) for f in range(8) for t in (1, 2))
