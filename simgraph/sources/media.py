"""Files as assets: scan, suffixes, probes, optional tables, vector files."""

from __future__ import annotations

import io
import json
import struct
import subprocess
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from ..functions.hash import asset_id, content_id

#: Suffixes of images and videos.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
VIDEOS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")


def classify_suffix(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds suffix, kind (image, video or null) and basename."""
    s = F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1))
    kind = F.when(s.isin(*IMAGES), "image").when(s.isin(*VIDEOS), "video")
    return df.withColumns({"suffix": s, "kind": kind, "basename": F.element_at(F.split(path, "/"), -1)})


def scan_media(spark: SparkSession, folder: str, with_hash: bool = True) -> DataFrame:
    """``(asset_id, path, type, size, mtime[, sha256])`` of all media files below a folder.

    Without ``with_hash`` contents are not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = classify_suffix(f).filter("kind is not null").withColumn("mtime", F.unix_timestamp("modificationTime"))
    out = [asset_id(F.col("path"), F.col("length"), F.col("mtime")).alias("asset_id"), "path", F.col("kind").alias("type"), F.col("length").alias("size"), "mtime"]
    return f.select(*out, *([content_id(F.col("content")).alias("sha256")] if with_hash else []))


def probe(df: DataFrame, prober: Callable[[str], dict], path: str = "path") -> DataFrame:
    """Adds width, height, fps, duration and codec that ``prober`` gives for a path.

    A file that cannot be read or understood (OSError, ValueError, a failed or missing program) gives nulls; any other error
    is one of the prober and stops the job. fps comes as numerator and denominator; a zero denominator is null.
    """
    names = {"width": pa.int32(), "height": pa.int32(), "fps_num": pa.float64(), "fps_den": pa.float64(), "duration": pa.float64(), "format_duration": pa.float64(), "codec": pa.string()}

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(b.schema.get_field_index(path)).to_pylist():
                try:
                    rows.append(prober(p))
                except (OSError, ValueError, subprocess.SubprocessError):
                    rows.append({})
            new = [pa.array([r.get(n) for r in rows], t) for n, t in names.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    out = df.mapInArrow(run, base + ", width int, height int, fps_num double, fps_den double, duration double, format_duration double, codec string")
    fps = F.when(F.col("fps_den") != 0, F.col("fps_num") / F.col("fps_den"))
    return out.withColumns({"fps": fps, "duration": F.coalesce("duration", "format_duration")}).drop("fps_num", "fps_den", "format_duration")


def ffprobe(path: str) -> dict:
    """What the ``ffprobe`` program tells of a video's first stream."""
    fields = "stream=width,height,r_frame_rate,duration,codec_name:format=duration"
    told = json.loads(subprocess.run(["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", fields, "-of", "json", path], capture_output=True, check=True).stdout)
    if not told.get("streams"):
        raise ValueError(f"no video stream: {path}")
    s = told["streams"][0]
    num, _, den = s.get("r_frame_rate", "0/0").partition("/")
    number = lambda x: None if x in (None, "N/A") else float(x)
    return {"width": s.get("width"), "height": s.get("height"), "fps_num": float(num), "fps_den": float(den or 0), "duration": number(s.get("duration")), "format_duration": number(told.get("format", {}).get("duration")), "codec": s.get("codec_name")}


def image_size(content: bytes) -> tuple[int, int]:
    """(width, height) that the header of a PNG, JPEG, BMP, WebP or TIFF file gives; ValueError for others."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", content[16:24])
        if content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            return w, abs(h)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return _webp_size(content)
        if content[:2] == b"\xff\xd8":
            return _jpeg_size(content)
        if content[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_size(content)
    except (struct.error, IndexError) as e:
        raise ValueError("a header is cut off") from e
    raise ValueError("not an image of a known kind")


def _webp_size(c: bytes) -> tuple[int, int]:
    kind = c[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(c[24:27], "little"), 1 + int.from_bytes(c[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(c[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    w, h = struct.unpack("<HH", c[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _jpeg_size(c: bytes) -> tuple[int, int]:
    at = 2
    while True:
        mark, size = c[at + 1], int.from_bytes(c[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", c[at + 5 : at + 9])
            return w, h
        at += 2 + size


def _tiff_size(c: bytes) -> tuple[int, int]:
    end = "<" if c[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", c[4:8])
    (n,) = struct.unpack(end + "H", c[at : at + 2])
    found = {}
    for i in range(n):
        tag, kind, _ = struct.unpack(end + "HHI", c[at + 2 + 12 * i : at + 10 + 12 * i])
        if tag in (256, 257):
            raw = c[at + 10 + 12 * i : at + 14 + 12 * i]
            found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
    if len(found) < 2:
        raise ValueError("a TIFF file without a size")
    return found[256], found[257]


def image_sizes(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds width and height of the images in ``content``; null where it is null or no image."""

    def run(batches):
        for b in batches:
            got = []
            for c in b.column(b.schema.get_field_index(content)):
                try:
                    got.append(image_size(c.as_py()) if c.is_valid else (None, None))
                except ValueError:
                    got.append((None, None))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in got], pa.int32()) for k in (0, 1))], [*b.schema.names, "width", "height"])

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, base + ", width int, height int")


def playable(index: DataFrame) -> DataFrame:
    """Videos with a positive duration, which alone can be sampled, and everything that is no video."""
    return index.filter((F.col("type") != "video") | (F.col("duration") > 0))


def measured(index: DataFrame) -> DataFrame:
    """Assets whose width and height are known and positive."""
    return index.filter((F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0))


def write_json(df: DataFrame, folder: str, key: str) -> None:
    """One folder of JSON documents a key, with the key inside each document too."""
    df.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(folder)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def load_npy(content):
    """Vectors from the bytes of .npy files."""

    def run(blobs):
        for b in blobs:
            yield pd.Series([np.load(io.BytesIO(c), allow_pickle=False).astype(float).ravel() for c in b])

    return pandas_udf(run, "array<double>", PandasUDFType.SCALAR_ITER)(content)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, embedding)`` of a folder of .npy files, named by id."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("id"), load_npy("content").alias("embedding"))


def read_json(spark: SparkSession, folder: str, schema) -> DataFrame:
    """One JSON document a file, under a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(folder)


def path_of(index: DataFrame, wanted: str) -> DataFrame:
    """The path of one asset; no row if unknown."""
    return index.filter(F.col("asset_id") == wanted).select("path")
