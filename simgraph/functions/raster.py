"""Image grids in numpy: area resize, grey, and the DCT hash, as Arrow-batched functions."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def area_weights(n: int, m: int) -> np.ndarray:
    """Rows of m output cells over n input cells, by covered length."""
    w, step = np.zeros((m, n)), n / m
    for i in range(m):
        lo, hi = i * step, (i + 1) * step
        for j in range(int(lo), min(n, int(np.ceil(hi)))):
            w[i, j] = max(0.0, min(hi, j + 1) - max(lo, j)) / step
    return w


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    a, b = area_weights(x.shape[0], height), area_weights(x.shape[1], width)
    return np.einsum("ih,hw...,jw->ij...", a, x.astype(float), b, optimize=True)


def grey(bgr: np.ndarray) -> np.ndarray:
    """The luma weights of red, green and blue."""
    return np.rint(0.299 * bgr[..., 2] + 0.587 * bgr[..., 1] + 0.114 * bgr[..., 0])


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)
    c = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


def bits_hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):0{max(1, bits.size // 4)}x}"


def hash_image(bgr: np.ndarray) -> dict[str, str]:
    """ahash, dhash and phash of an image."""
    a = np.rint(grey(np.rint(resize(bgr, 8, 8))))
    d = np.rint(grey(np.rint(resize(bgr, 8, 9))))
    p = np.rint(grey(np.rint(resize(bgr, 32, 32))))
    c = dct_matrix(32)
    low = (c @ p @ c.T)[:8, :8]
    return {"ahash": bits_hex(a > a.mean()), "dhash": bits_hex(d[:, 1:] > d[:, :-1]), "phash": bits_hex(low > np.median(low))}


def _bits_hex(bits: np.ndarray) -> list[str]:
    """Rows of 64 booleans as 16 hex digits each."""
    packed = np.packbits(bits.reshape(len(bits), -1), axis=1)
    return [r.tobytes().hex() for r in packed]


def grid_phash(grid) -> Column:
    """DCT hash of 8x8 grids, each a row-major array; null for a null."""

    def run(grids: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(grids), grids.index, dtype=object)
        some = grids.notna()
        if some.any():
            c, x = dct_matrix(8), np.stack(grids[some].to_numpy()).astype(float).reshape(-1, 8, 8)
            x = (c @ x @ c.T).reshape(len(x), 64)
            out[some] = _bits_hex(x > np.median(x, axis=1, keepdims=True))
        return out

    return pandas_udf(run, "string")(grid)


def _hash_images(bgr: np.ndarray) -> dict[str, list[str]]:
    """The three hashes of many images of one size."""
    n, h, w = bgr.shape[:3]

    def small(height: int, width: int) -> np.ndarray:
        x = np.einsum("ih,nhwc,jw->nijc", area_weights(h, height), bgr.astype(float), area_weights(w, width), optimize=True)
        return grey(np.rint(x))

    a, d, p = small(8, 8), small(8, 9), small(32, 32)
    c = dct_matrix(32)
    low = (c @ p @ c.T)[:, :8, :8].reshape(n, 64)
    a = a.reshape(n, 64)
    return {"ahash": _bits_hex(a > a.mean(1, keepdims=True)), "dhash": _bits_hex(d[:, :, 1:] > d[:, :, :-1]), "phash": _bits_hex(low > np.median(low, axis=1, keepdims=True))}


def raster_hashes(height, width, pixels) -> Column:
    """Struct of ahash, dhash and phash of raw BGR images; images of one size are hashed at once."""

    def run(h: pd.Series, w: pd.Series, px: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(index=px.index, columns=["ahash", "dhash", "phash"], dtype=object)
        for (y, x), part in px[px.notna()].groupby([h, w]):
            for at in range(0, len(part), 64):
                some = part.iloc[at : at + 64]
                got = _hash_images(np.stack([np.frombuffer(p, np.uint8).reshape(int(y), int(x), 3) for p in some]))
                for k, v in got.items():
                    out.loc[some.index, k] = v
        return out

    return pandas_udf(run, "struct<ahash:string,dhash:string,phash:string>")(height, width, pixels)


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The pixels of a box, fractions dropped; empty where the box lies outside."""
    x1, y1, x2, y2 = (max(0, int(v)) for v in box)
    return image[y1:y2, x1:x2]


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resized by linear interpolation between the centres of pixels, in floating point."""

    def weights(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        w = np.zeros((m, n))
        np.add.at(w, (np.arange(m), low), 1 - (at - low))
        np.add.at(w, (np.arange(m), high), at - low)
        return w

    return np.einsum("ih,hwc,jw->ijc", weights(image.shape[0], height), image.astype(float), weights(image.shape[1], width), optimize=True)


#: Mean and spread of red, green and blue that image encoders are trained with.
MEAN, SPREAD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def encoder_input(bgr: np.ndarray, size: int = 224) -> np.ndarray:
    """(3, size, size) of red, green and blue, resized and normalised."""
    x = bilinear(bgr[..., ::-1], size, size) / 255.0
    return ((x - MEAN) / SPREAD).transpose(2, 0, 1).astype(np.float32)


def body_input(bgr: np.ndarray, height: int = 256, width: int = 128) -> np.ndarray:
    """(3, height, width) of red, green and blue between 0 and 1."""
    return (np.rint(bilinear(bgr[..., ::-1], height, width)) / 255.0).transpose(2, 0, 1).astype(np.float32)
