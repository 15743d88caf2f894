"""Perceptual hashes, their bands and distances as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_to_hex(bits: Column) -> Column:
    """An array of 64 booleans, most significant first, as 16 hex digits."""
    text = F.array_join(F.transform(bits, lambda b: F.when(b, F.lit("1")).otherwise("0")), "")
    half = lambda at: F.lpad(F.lower(F.conv(F.substring(text, at, 32), 2, 16)), 8, "0")
    return F.concat(half(1), half(33))


def ahash(grid: Column) -> Column:
    """Bits of an 8x8 grid: cell above the mean."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / F.size(grid)
    return bits_to_hex(F.transform(grid, lambda x: x > mean))


def dhash(grid: Column, width: int = 9, height: int = 8) -> Column:
    """Bits of a row-major grid: cell above its left neighbour; padded with zeros to 64."""
    cells = [F.get(grid, F.lit(r * width + c + 1)) > F.get(grid, F.lit(r * width + c)) for r in range(height) for c in range(width - 1)]
    cells += [F.lit(False)] * (64 - len(cells))
    return bits_to_hex(F.array(*cells[:64]))


def to_long(hexed: Column) -> Column:
    """16 hex digits as a signed 64-bit integer."""
    return F.conv(hexed, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hashes."""
    return F.bit_count(to_long(a).bitwiseXOR(to_long(b)))


def band_slices(bands: int, digits: int = 16) -> list[tuple[int, int]]:
    """(start, length) of contiguous bands; the first ones are one digit longer where they don't divide."""
    base, more = divmod(digits, bands)
    out, at = [], 0
    for i in range(bands):
        n = base + (i < more)
        out.append((at, n))
        at += n
    return out


def band_keys(hexed: Column, bands: int) -> Column:
    """Array of (band, key). Sixteen bands or more work on single bits, so that no band is empty."""
    if bands <= 16:
        return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(hexed, s + 1, n).alias("key")) for i, (s, n) in enumerate(band_slices(bands))])
    bits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 8 * h, 8), 16, 2), 32, "0") for h in (0, 1)])
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(bits, s + 1, n).alias("key")) for i, (s, n) in enumerate(band_slices(bands, 64))])


def simhash(df: DataFrame, id_col: str, text_col: str, out: str = "phash") -> DataFrame:
    """``(id_col, out)``: 64-bit SimHash over the distinct lower-case tokens of each id's text, as 16 hex digits.

    A token's hash is the first half of its MD5; a bit is 1 where more tokens have 1 there than 0. Two bits are counted in the
    halves of one sum, so a text's tokens become 33 sums that are added before anything is shuffled.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"([^ \n\t\r]+)")))
    long = df.select(id_col, F.explode_outer(tokens).alias("_t"))
    long = long.select(id_col, F.conv(F.substring(F.md5("_t"), 1, 16), 16, -10).cast("bigint").alias("_h"))
    pair = lambda k: F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(0x0000000100000001))
    sums = long.groupBy(id_col).agg(F.count("_h").alias("_n"), *[F.sum(pair(k)).alias(f"_s{k}") for k in range(32)])
    above = lambda n, k: F.shiftleft(F.when(2 * n > F.col("_n"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), k)
    low = [above(F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k) for k in range(32)]
    high = [above(F.shiftrightunsigned(f"_s{k}", 32), k) for k in range(32)]
    half = lambda parts: F.lpad(F.lower(F.hex(reduce(lambda x, y: x.bitwiseOR(y), parts))), 8, "0")
    return sums.select(id_col, F.concat(half(high), half(low)).alias(out))


def asset_id(path: Column, size: Column, mtime: Column) -> Column:
    """Identity of a file at a place and version."""
    return F.sha1(F.concat(path, size.cast("string"), mtime.cast("string")))


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)
