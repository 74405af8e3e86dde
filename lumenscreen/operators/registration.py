"""Registration of many pairs of images by Fourier transforms, which are made in tasks and never stored.

A transform has 12 times an image's bytes and more, so images travel, not transforms. Images are numbered in the order of
their keys and cut into blocks; the pairs between two blocks are one stream, which gets each of its images once and makes
its transforms once. The transform of a reversed image follows from the image's own by conjugation and a phase, so an
image can be on either side. A pair costs six inverse transforms.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored
from .spread import MOST_BROADCAST, Step, join_key, numbers, ranked, streamed

#: Images of a block at most.
STREAM = 32
#: Bytes of a block's transforms at most, if it has more than one image.
BLOCK_BYTES = 64_000_000
#: Rows of several megabytes: batches are bounded in bytes.
BATCH_BYTES = 64_000_000


def fast_size(shape: list[int]) -> tuple[int, int]:
    return tuple(1 << (n - 1).bit_length() for n in shape)


def transform(image: np.ndarray, fast: tuple[int, int]) -> np.ndarray:
    """Transforms of an image's values, their squares and its mask; not-a-number is masked."""
    mask = ~np.isnan(image)
    values = np.where(mask, image, 0.0)
    return np.stack([np.fft.rfft2(x, fast) for x in (values, values * values, mask.astype(float))])


def _reversed(spectrum: np.ndarray, shape: tuple[int, int], fast: tuple[int, int]) -> np.ndarray:
    """Transforms of the image turned round by both axes."""
    rows, cols = (np.exp(-2j * np.pi * np.arange(n) * (size - 1) / full) for n, size, full in zip(spectrum.shape[1:], shape, fast, strict=True))
    return np.conj(spectrum) * rows[:, None] * cols


def correlation(fixed: np.ndarray, moving: np.ndarray, fixed_shape: tuple[int, int], moving_shape: tuple[int, int], fast: tuple[int, int], least_overlap: float) -> np.ndarray:
    """The masked normalised cross-correlation at all shifts, from the transforms of two images."""
    shape = [a + b - 1 for a, b in zip(fixed_shape, moving_shape, strict=True)]
    back = lambda x: np.fft.irfft2(x, fast)[: shape[0], : shape[1]]
    (f, f2, fm), (m, m2, mm) = fixed, _reversed(moving, moving_shape, fast)
    overlap = np.maximum(np.round(back(fm * mm)), np.finfo(float).eps)
    f_sum, m_sum = back(f * mm), back(fm * m)
    f_var = np.maximum(back(f2 * mm) - f_sum**2 / overlap, 0)
    m_var = np.maximum(back(fm * m2) - m_sum**2 / overlap, 0)
    scale = np.sqrt(f_var * m_var)
    enough = scale > 1e3 * np.finfo(float).eps * max(scale.max(), 1e-300)
    out = np.zeros(shape)
    np.divide(back(f * m) - f_sum * m_sum / overlap, scale, out=out, where=enough)
    out[overlap < least_overlap * overlap.max()] = 0
    return np.clip(out, -1, 1)


def placement(cc: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> tuple[float, float, float]:
    """The largest correlation and the mean of its shifts, which lay the target over the source."""
    shift = np.argwhere(cc >= cc.max() - 1e-9).mean(0) - np.array(source) + 1
    row, col = -shift + (np.array(target) - np.array(source)) / 2
    return float(cc.max()), float(row), float(col)


def image_transforms(images: DataFrame, keys: list[str]) -> DataFrame:
    """A stored row for each image (keys, height, width, pixels row by row): all that its transforms are made from.

    ``fast`` is the size that all are padded to, at most four times the largest image in each direction; transforms have
    48 bytes for each of half its places. Null pixels are masked.
    """
    table = stored(images.select(*keys, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels")))
    most = table.agg(F.max("height").alias("h"), F.max("width").alias("w")).first()
    return table.withColumn("fast", F.array(*[F.lit(n) for n in fast_size([2 * (most.h or 1) - 1, 2 * (most.w or 1) - 1])]))


def _pair_scores(columns: list[str], least_overlap: float):
    """Streams of the images of two blocks (_kind 0), then of pairs of them by number."""

    class Pairs(Step):
        def __init__(self, first: pa.Table | None):
            super().__init__(first)
            self.at = {number: i for i, number in enumerate(first["_i"].to_pylist())} if first is not None else {}
            self.made: dict[int, tuple | None] = {}

        def transforms(self, number: int) -> tuple | None:
            """An image's transforms, shape and padded size; none without any valid pixel."""
            if number not in self.made:
                row = self.first.slice(self.at[number], 1)
                h, w, pixels, fast = (row[n][0] for n in ("_height", "_width", "_pixels", "_fast"))
                self.made[number] = None
                if pixels.is_valid and h.is_valid and w.is_valid and len(pixels.values):
                    image = pixels.values.to_numpy(zero_copy_only=False).reshape(h.as_py(), w.as_py())
                    if not np.isnan(image).all():
                        self.made[number] = transform(image, tuple(fast.as_py())), image.shape, tuple(fast.as_py())
            return self.made[number]

        def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = []
            for source, target in zip(numbers(batch, "_s", np.int64).tolist(), numbers(batch, "_t", np.int64).tolist(), strict=True):
                moving, fixed = self.transforms(source), self.transforms(target)
                found.append((None, None, None) if moving is None or fixed is None else placement(correlation(fixed[0], moving[0], fixed[1], *moving[1:], least_overlap), moving[1], fixed[1]))
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([f[k] for f in found], pa.float64()) for k in range(3)]], names=[*columns, "cc", "shift_row", "shift_col"])

    return Pairs


def registered(transforms: DataFrame, pairs: DataFrame, keys: list[str], source: list[str], target: list[str], least_overlap: float = 0.3) -> DataFrame:
    """pairs with cc (the largest correlation) and shift_row, shift_col, which lay the target over the source.

    The columns ``source`` and ``target`` of pairs name images by the keys of ``transforms``, in this order. Equal largest
    correlations (to 1e-9) give the mean of their shifts. A pair with an unknown image, or one without valid pixels, has nulls.
    """
    spark = pairs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own = [f"_k{i}" for i in range(len(keys))]
    images = transforms.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[F.col(c).alias(f"_{c}") for c in ("height", "width", "fast", "pixels")])
    one = images.select("_fast").first()
    size = max(1, min(STREAM, BLOCK_BYTES // (48 * one[0][0] * (one[0][1] // 2 + 1)))) if one else 1
    numbered = stored(ranked(images.select(*own), [], own, "_i"))
    few = numbered.count() <= MOST_BROADCAST

    def looked_up(rows: DataFrame, names: list[str], number: str) -> DataFrame:
        known = numbered.select(*[F.col(o).alias(f"{number}{o}") for o in own], F.col("_i").alias(number))
        on = functools.reduce(operator.and_, [rows[c] == F.col(f"{number}{o}") for c, o in zip(names, own, strict=True)])
        return rows.join(F.broadcast(known) if few else known, on, "left").drop(*[f"{number}{o}" for o in own])

    asked = stored(looked_up(looked_up(pairs, source, "_s"), target, "_t"))
    known = asked.where("_s IS NOT NULL AND _t IS NOT NULL").withColumns({b: F.floor((F.col(n) - 1) / size) for b, n in (("_a", "_s"), ("_b", "_t"))})
    sides = [known.select("_a", "_b", F.col(n).alias("_i"), *[F.col(c).alias(o) for c, o in zip(names, own, strict=True)]) for n, names in (("_s", source), ("_t", target))]
    sent = join_key(images, stored(sides[0].union(sides[1]).distinct()), own).drop(*own).withColumn("_kind", F.lit(0))
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("cc", "shift_row", "shift_col")]])
    found = streamed(known.withColumn("_kind", F.lit(1)).unionByName(sent, allowMissingColumns=True), ["_a", "_b"], ["_s"], _pair_scores(pairs.columns, least_overlap), schema)
    unknown = asked.where("_s IS NULL OR _t IS NULL").select(*pairs.columns, *[F.lit(None).cast("double").alias(n) for n in ("cc", "shift_row", "shift_col")])
    return found.unionByName(unknown)
