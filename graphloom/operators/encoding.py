"""Entities encoded once, however many pairs they stand in: text, image and graph in a chain, kept and gathered.

A chain is named by its parts, so that any of them can be left out: a part called `none` adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import fused, hashed_bag
from .messages import ENCODERS, encoder
from .neighbours import written


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _whole(image: Column, missing: list[float]) -> Column:
    """An image vector, or the one that stands for a missing one."""
    return F.coalesce(image.cast("array<double>"), F.array(*map(F.lit, missing)))


def _there(image: Column) -> Column:
    return F.array(F.when(image.isNull(), 0.0).otherwise(1.0))


#: Text encoders by name: text, length of the vector.
TEXTS: dict[str, Callable[[Column, int], Column]] = {"bag": hashed_bag, "none": lambda text, n: _zeros(n)}
#: Fusions by name: text vector, image vector or null, the vector for a missing image, weights and bias of a layer.
FUSIONS: dict[str, Callable[..., Column]] = {
    "mlp": lambda text, image, missing, weights, bias: fused(text, image, missing, weights, bias),
    "concat": lambda text, image, missing, weights, bias: F.concat(text, _whole(image, missing), _there(image)),
    "text": lambda text, image, missing, weights, bias: text,
    "image": lambda text, image, missing, weights, bias: _whole(image, missing),
}


def _named(kind: str, name: str, known: dict):
    if name.lower() not in known:
        raise ValueError(f"no {kind} {name!r}; there are {', '.join(known)}")
    return known[name.lower()]


@dataclass(frozen=True)
class Chain:
    """A chain of encoders by name. missing stands for an image that isn't there; weights and bias are those of `mlp`."""

    text: str = "bag"
    fusion: str = "concat"
    graph: str = "blend"
    size: int = 64
    missing: tuple[float, ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()
    bias: tuple[float, ...] = ()

    def features(self, entities: DataFrame) -> DataFrame:
        """(node, vector) of entities (node, text, image), each by itself."""
        text, fusion = _named("text encoder", self.text, TEXTS), _named("fusion", self.fusion, FUSIONS)
        vector = fusion(text(F.col("text"), self.size), F.col("image"), list(self.missing), [list(w) for w in self.weights], list(self.bias))
        return entities.select("node", vector.alias("vector"))

    def encode(self, wanted: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
        """(node, vector) of the wanted entities, each once; edges: src, dst. Only they and the sources of edges to
        them are looked at. A wanted node that is no entity has no row."""
        _named("graph encoder", self.graph, ENCODERS)
        wanted = wanted.select("node").distinct()
        if self.graph.lower() == "nohop":
            return self.features(entities.join(wanted, "node", "left_semi"))
        near = written(edges.join(wanted.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        needed = wanted.unionByName(near.select(F.col("src").alias("node"))).distinct()
        features = written(self.features(entities.join(needed, "node", "left_semi")))
        return encoder(self.graph)(near, features).join(wanted, "node", "left_semi")


def ends(pairs: DataFrame, h: str = "h", t: str = "t") -> DataFrame:
    """(node): every entity that stands in a pair, once."""
    return pairs.select(F.explode(F.array(h, t)).alias("node")).filter("node IS NOT NULL").distinct()


def with_cache(wanted: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """(node, vector) of the wanted nodes: those in the cache from there, the others from encode(missing), called once.

    What was made is added to `folder`, by key ranges, for the next run to read as its cache.
    """
    wanted = wanted.select("node").distinct()
    missing = written(wanted.join(cache.select("node"), "node", "left_anti"))
    fresh = encode(missing).select("node", "vector")
    fresh = fresh.repartitionByRange("node").sortWithinPartitions("node")
    if folder:
        fresh = written(fresh)
        fresh.write.mode("append").parquet(folder)
    else:
        fresh = written(fresh)
    return cache.select("node", "vector").join(wanted, "node", "left_semi").unionByName(fresh)


def gathered(pairs: DataFrame, vectors: DataFrame, h: str = "h", t: str = "t") -> DataFrame:
    """pairs with h_vector and t_vector. A pair whose end has no vector is left out."""
    sides = [vectors.select(F.col("node").alias(c), F.col("vector").alias(f"{c}_vector")) for c in (h, t)]
    return pairs.join(sides[0], h).join(sides[1], t)
