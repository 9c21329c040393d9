"""Tensors as flat row-major float arrays: rescaling, normalising, patches, statistics, bicubic resizing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(values: Column, factor: float) -> Column:
    return F.transform(values, lambda x: (x * F.lit(factor).cast("float")).cast("float"))


def normalise(values: Column, mean: tuple[float, ...], std: tuple[float, ...]) -> Column:
    """(x - mean) / std in single precision, by channel of interleaved values."""
    n = len(mean)
    pick = lambda v, i: F.get(F.array(*[F.lit(x).cast("float") for x in v]), F.pmod(i, F.lit(n)))
    return F.transform(values, lambda x, i: ((x - pick(mean, i)).cast("float") / pick(std, i)).cast("float"))


def patch_position(i: Column, frames: int, channels: int, height: int, width: int, patch: int, merge: int) -> tuple[Column, Column]:
    """Row and column in the patch matrix of element ``i`` of a (frames, channels, height, width) tensor."""
    whole = lambda a, b: F.floor(a / b).cast("int")
    x, y = i % width, whole(i, width) % height
    c, t = whole(i, width * height) % channels, whole(i, width * height * channels)
    block = patch * merge
    row = ((whole(y, block) * (width // block) + whole(x, block)) * merge + whole(y % block, patch)) * merge + whole(x % block, patch)
    col = ((c * frames + t) * patch + y % patch) * patch + x % patch
    return row, col


def patches(image: np.ndarray, patch: int, merge: int) -> np.ndarray:
    """The patch matrix of a (frames, channels, height, width) tensor."""
    t, c, h, w = image.shape
    split = image.reshape(t, c, h // (patch * merge), merge, patch, w // (patch * merge), merge, patch)
    return split.transpose(2, 5, 3, 6, 1, 0, 4, 7).reshape((h // patch) * (w // patch), c * t * patch * patch)


def with_frames(image: np.ndarray, temporal: int) -> np.ndarray:
    """A (channels, height, width) image as frames, the last repeated up to a multiple of ``temporal``."""
    return np.repeat(image[None], max(1, temporal), axis=0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), -0.5
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


#: Bits after the point of a weight.
WEIGHT_BITS = 22


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Antialiased bicubic resizing of (rows, columns, channels) bytes, rounded to bytes after each axis.

    Weights are whole numbers of 2^-WEIGHT_BITS, so sums are exact and ties don't depend on their order.
    """
    for axis, size in ((1, width), (0, height)):
        n = image.shape[axis]
        if n == size:
            continue
        scale = n / size
        wide = max(scale, 1.0)
        at = (np.arange(size) + 0.5) * scale
        weights = _cubic((np.arange(n)[None] + 0.5 - at[:, None]) / wide)
        weights /= weights.sum(axis=1, keepdims=True)
        whole = np.trunc(weights * (1 << WEIGHT_BITS) + np.where(weights < 0, -0.5, 0.5))
        moved = np.tensordot(whole, image.astype(np.float64), axes=(1, axis))  # below 2^53: exact
        image = np.clip(np.floor(((moved if axis == 0 else moved.transpose(1, 0, 2)) + (1 << WEIGHT_BITS - 1)) / (1 << WEIGHT_BITS)), 0, 255).astype(np.uint8)
    return image


def stats(values: Column) -> tuple[Column, Column]:
    """Mean and population deviation in double precision, the deviation from the mean in a second pass."""
    n = F.size(values)
    summed = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    square = F.get(F.transform(F.array(summed), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))), F.lit(0))
    return summed, F.sqrt(square / n)


def element_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda s, x: s * x)
