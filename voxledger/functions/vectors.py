"""Vector and label-array functions, all inside the JVM. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rescale(c: Column) -> Column:
    """From -1..1 to 0..1."""
    return (c + 1) / 2


def pad_right(labels: Column, size: int | Column, filler: int) -> Column:
    """The first ``size`` labels, filled up at the right."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(labels, F.array_repeat(F.lit(filler), n.cast("int"))), F.lit(1), n.cast("int"))


def attention(labels: Column, size: int | Column) -> Column:
    """1 for a label, 0 for filling."""
    return pad_right(F.transform(labels, lambda _: F.lit(1)), size, 0)


def shift_right(labels: Column, start: int) -> Column:
    """Decoder input: the start label before all but the last."""
    return F.concat(F.array(F.lit(start)), F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))


def mask_labels(padded: Column, length: Column, prompt: Column, ignored: int = -100) -> Column:
    """Labels with the prompt's and the filling's positions ignored by the loss."""
    return F.transform(padded, lambda x, i: F.when((i < prompt) | (i >= length), F.lit(ignored)).otherwise(x))


def label_length_ok(labels: Column, most: int) -> Column:
    """At least one label and fewer than ``most``."""
    return F.size(labels).between(1, most - 1)
