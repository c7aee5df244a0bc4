"""Image kernels over decoded pixels: a grey or colour image is an array of bytes with its width and height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def pixels(data: bytes, width: int, height: int) -> np.ndarray:
    """height, width, channels as floats."""
    return np.frombuffer(data, np.uint8).reshape(height, width, -1).astype(float)


def shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Means over a grid of size by size cells."""
    rows, cols = (np.linspace(0, n, size + 1).astype(int) for n in image.shape[:2])
    return np.array([[image[r : max(r + 1, s), c : max(c + 1, d)].mean() for c, d in zip(cols, cols[1:], strict=False)] for r, s in zip(rows, rows[1:], strict=False)])


def average_hash(image: np.ndarray, size: int = 8) -> str:
    """Cells at or above their mean, as hex digits, four cells each."""
    grey = shrink(image.mean(axis=2), size).reshape(-1)
    bits = (grey >= grey.mean()).astype(np.uint8)
    return np.packbits(bits).tobytes().hex()


def colour_histogram(image: np.ndarray, bins: int = 8) -> list[float]:
    """Shares of `bins` levels of each of three channels, one after the other."""
    rgb = image if image.shape[2] == 3 else np.repeat(image[:, :, :1], 3, axis=2)
    at = np.minimum((rgb * bins / 256).astype(int), bins - 1).reshape(-1, 3)
    return [float(x) for c in range(3) for x in np.bincount(at[:, c], minlength=bins) / len(at)]


def statistics(image: np.ndarray) -> dict[str, object]:
    """Edges, exposure, and the silhouette against the border's colour: its box as parts of the image, area, digest."""
    grey = image.mean(axis=2)
    dy, dx = np.abs(np.diff(grey, axis=0)), np.abs(np.diff(grey, axis=1))
    edge = np.concatenate([grey[0], grey[-1], grey[:, 0], grey[:, -1]])
    mask = np.abs(grey - np.median(edge)) > 24
    ys, xs = np.nonzero(mask)
    box = [float(xs.min() / grey.shape[1]), float(ys.min() / grey.shape[0]), float((xs.max() + 1) / grey.shape[1]), float((ys.max() + 1) / grey.shape[0])] if len(xs) else None
    steps = np.concatenate([dy.reshape(-1), dx.reshape(-1)])
    return {"edge_mean": float(steps.mean()) if len(steps) else 0.0, "edge_share": float((steps > 24).mean()) if len(steps) else 0.0, "exposure": float(grey.mean() / 255), "subject_area": float(mask.mean()), "box": box, "mask": average_hash(mask[:, :, None].astype(float)) if len(xs) else None}


STATISTICS = StructType([StructField("edge_mean", DoubleType()), StructField("edge_share", DoubleType()), StructField("exposure", DoubleType()), StructField("subject_area", DoubleType()), StructField("box", ArrayType(DoubleType())), StructField("mask", StringType())])


@F.pandas_udf(StringType())
def hash_of(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([average_hash(pixels(*x)) for x in zip(data, width, height, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def histogram_of(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([colour_histogram(pixels(*x)) for x in zip(data, width, height, strict=True)])


@F.pandas_udf(STATISTICS)
def statistics_of(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(pixels(*x)) for x in zip(data, width, height, strict=True)], columns=[f.name for f in STATISTICS])


def view_of(width: Column, height: Column, parent_width: Column, parent_height: Column, text: Column, area: Column) -> Column:
    """Kind of view of a crop: a label if it has writing, a detail if it is a small part, else by its shape."""
    part, shape = width * height / (parent_width * parent_height), width / height
    return F.when(F.length(text) > 0, "label").when(part < 0.2, "detail").when(area < 0.05, "unknown").when(shape > 1.3, "lateral").when(shape < 0.77, "front").otherwise("top")
