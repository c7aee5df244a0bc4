"""Vectors and hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def histogram_similarity(a: Column, b: Column) -> Column:
    """1 less half the sum of absolute differences, 0 at least; 0 where the lengths differ."""
    gap = total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.lit(0.0), 1 - 0.5 * gap)).otherwise(0.0)


def hex_distance(a: Column, b: Column) -> Column:
    """Number of places with other characters; the longer's rest counts in full."""
    n = F.least(F.length(a), F.length(b))
    differ = F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))))
    return differ + F.abs(F.length(a) - F.length(b))


def hash_similarity(a: Column, b: Column) -> Column:
    """Distance over 64, whatever the hashes' length, so 0.75 at least for 16 characters."""
    return 1 - hex_distance(a, b) / 64


DIM = 64


def term_bucket(term: Column, dim: int = DIM) -> Column:
    """First eight hex digits of the SHA-256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_vector(terms: Column, dim: int = DIM) -> Column:
    """Counts of hashed terms, scaled to length 1; zeros if there are none."""
    at = F.transform(terms, lambda t: term_bucket(t, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda b: b == i)).cast("double"))
    size = norm(counts)
    return F.when(size > 0, F.transform(counts, lambda c: c / size)).otherwise(counts)


def byte_fingerprint(samples: Column) -> Column:
    """64 samples against their mean as 16 hex digits."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)
    nibbles = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lower(F.hex(sum(((F.when(F.get(samples, i * 4 + k) >= mean, 1).otherwise(0)) * 2 ** (3 - k) for k in range(4)), F.lit(0)).cast("long"))))
    return F.array_join(nibbles, "")


def image_family(family: Column, digest: Column, phash: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(family, F.lit("")), F.nullif(digest, F.lit("")), F.concat(F.lit("phash:"), F.nullif(phash, F.lit(""))), F.sha2(url, 256))
