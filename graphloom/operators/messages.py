"""Message passing with given weights: mean of neighbours, means by relation, centroids."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import sent


def _summed(rows: DataFrame, keys: list[str], vector: str, how: str) -> DataFrame:
    """A sum or mean of each key's vectors, made on the JVM in one buffer a key: what is shuffled is a row for each key and
    task, whatever the vectors' length. Null vectors count for nothing."""
    whole = array_to_vector(F.col(vector).cast("array<double>"))
    found = Summarizer.mean(whole) if how == "mean" else Summarizer.sum(whole)
    return rows.filter(F.col(vector).isNotNull()).groupBy(*keys).agg(vector_to_array(found).alias(vector))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The mean of each key's vectors, place by place; it is summed before rows are shuffled."""
    return _summed(rows, keys, vector, "mean")


def mean_aggregate(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, vector): the mean of the vectors of the nodes with an edge to it; nodes without any have no row."""
    sources = vectors.select(F.col("node").alias("src"), "vector")
    return mean_vectors(edges.select("src", F.col("dst").alias("node")).join(sources, "src"), ["node"])


def relational_aggregate(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, rel, vector): as mean_aggregate, for each relation by itself."""
    sources = vectors.select(F.col("node").alias("src"), "vector")
    return mean_vectors(edges.select("src", "rel", F.col("dst").alias("node")).join(sources, "src"), ["node", "rel"])


def sage_layer(edges: DataFrame, vectors: DataFrame, own: list[list[float]], neighbour: list[list[float]], bias: list[float]) -> DataFrame:
    """(node, vector): a dense layer of the node's own vector plus one of its neighbours' mean (zeros without any)."""
    from ..functions.vectors import dense

    zeros = F.array_repeat(F.lit(0.0), len(neighbour[0]))
    met = vectors.join(mean_aggregate(edges, vectors).withColumnRenamed("vector", "mean"), "node", "left").withColumn("mean", F.coalesce("mean", zeros))
    return met.select("node", F.zip_with(dense("vector", own, bias), dense("mean", neighbour, [0.0] * len(bias)), lambda a, b: a + b).alias("vector"))


def relational_layer(edges: DataFrame, vectors: DataFrame, own: list[list[float]], bases: list[list[list[float]]], shares: DataFrame, bias: list[float]) -> DataFrame:
    """(node, vector): own layer plus, over relations, the mean times the relation's matrix: a mix of bases.

    shares: (rel, share array), the weight of each base in a relation's matrix. Each base is applied once to the relation
    means mixed by share, so no matrix is made for a relation.
    """
    from ..functions.vectors import dense

    means = relational_aggregate(edges, vectors).join(sent(shares.select("rel", "share")), "rel")
    shared = lambda k: lambda x: x * F.element_at("share", k + 1)
    layers = [F.transform(dense("vector", base, [0.0] * len(bias)), shared(k)) for k, base in enumerate(bases)]
    mixed = layers[0]
    for layer in layers[1:]:
        mixed = F.zip_with(mixed, layer, lambda a, b: a + b)
    sums = _summed(means.select("node", mixed.alias("messages")), ["node"], "messages", "sum")
    zeros = F.array_repeat(F.lit(0.0), len(bias))
    met = vectors.join(sums, "node", "left").withColumn("messages", F.coalesce("messages", zeros))
    return met.select("node", F.zip_with(dense("vector", own, bias), "messages", lambda a, b: a + b).alias("vector"))


def blended(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, vector): half-way between the node's own vector and its neighbours' mean; its own without neighbours."""
    met = vectors.select("node", "vector").join(mean_aggregate(edges, vectors).withColumnRenamed("vector", "mean"), "node", "left")
    half = F.zip_with("vector", "mean", lambda a, b: (a + b) / 2)
    return met.select("node", F.when(F.col("mean").isNull(), F.col("vector")).otherwise(half).alias("vector"))


def no_hop(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, vector): vectors as they are; edges are not read."""
    return vectors.select("node", "vector")


#: Encoders by name.
ENCODERS = {"graphsage": sage_layer, "rgcn": relational_layer, "blend": blended, "nohop": no_hop}


def encoder(name: str):
    """The encoder of a name, whatever its case; an unknown one is an error."""
    if name.lower() not in ENCODERS:
        raise ValueError(f"no encoder {name!r}; there are {', '.join(ENCODERS)}")
    return ENCODERS[name.lower()]
