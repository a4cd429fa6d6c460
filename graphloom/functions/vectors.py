"""Expressions on arrays of doubles: distances, scores of triples, dense layers and losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value made once, however often `of` uses it, in lambdas, too."""
    return F.get(F.transform(F.array(value), of), 0)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_vector(x), _vector(y), lambda a, b: a * b))


def squared_distance(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_vector(x), _vector(y), lambda a, b: (a - b) * (a - b)))


def transe(head: Column | str, relation: Column | str, tail: Column | str) -> Column:
    """-‖h + r − t‖: the greater the better."""
    moved = F.zip_with(_vector(head), _vector(relation), lambda a, b: a + b)
    return -F.sqrt(squared_distance(moved, tail)) + 0.0


def complex_(head: Column | str, relation: Column | str, tail: Column | str) -> Column:
    """The real part of the trilinear product; the first half of each vector is real, the second imaginary."""
    half = (F.size(_vector(head)) / 2).cast("int")
    parts = lambda v: (F.slice(_vector(v), F.lit(1), half), F.slice(_vector(v), half + 1, half))
    (hr, hi), (rr, ri), (tr, ti) = parts(head), parts(relation), parts(tail)
    three = lambda a, b, c: total(F.zip_with(F.zip_with(a, b, lambda x, y: x * y), c, lambda x, y: x * y))
    return three(hr, rr, tr) + three(hi, rr, ti) + three(hr, ri, ti) - three(hi, ri, tr)


SCORERS: dict[str, Callable[..., Column]] = {"transe": transe, "complex": complex_}


def dense(x: Column | str, weights: list[list[float]], bias: list[float], relu: bool = False) -> Column:
    """A layer of fixed weights, one row of them for each output."""
    outputs = [dot(x, F.lit(row)) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)]
    return F.array(*[F.greatest(o, F.lit(0.0)) if relu else o for o in outputs])


def fused(text: Column | str, image: Column | str, missing: list[float], weights: list[list[float]], bias: list[float]) -> Column:
    """A dense layer over text, image (or the vector that stands for a missing one) and whether there is an image."""
    there = F.coalesce(F.col(image) if isinstance(image, str) else image, F.lit(missing))
    flag = F.when((F.col(image) if isinstance(image, str) else image).isNull(), 0.0).otherwise(1.0)
    return dense(F.concat(_vector(text), _vector(there), F.array(flag)), weights, bias, True)


def pair_score(x: Column | str, y: Column | str, hidden: list[list[float]], hidden_bias: list[float], out: list[float], out_bias: float) -> Column:
    """A link's score from its ends' vectors: one hidden layer over both, then one output."""
    return dot(dense(F.concat(_vector(x), _vector(y)), hidden, hidden_bias, True), F.lit(out)) + F.lit(float(out_bias))


def logit_loss(score: Column | str, label: Column | str) -> Column:
    """Cross entropy of a score before the logistic function, without overflow."""
    s, y = (F.col(c).cast("double") if isinstance(c, str) else c for c in (score, label))
    return F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))


def hashed_bag(text: Column | str, size: int = 64) -> Column:
    """Words counted in `size` buckets, scaled to length one: a text vector that needs no model. Blank texts give zeros."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\t\n\x0b\f\r ]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int"))
    counted = lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double"))
    scaled = lambda c: let(F.greatest(F.sqrt(dot(c, c)), F.lit(1.0)), lambda length: F.transform(c, lambda x: x / length))
    return let(let(buckets, counted), scaled)
