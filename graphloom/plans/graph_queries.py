"""Queries on the graph: catalog, triples, counts, neighbourhoods, samples, splits, negatives."""

from __future__ import annotations

from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import order_hash
from ..operators import catalog as C
from ..operators import neighbours as N
from ..operators import negatives, splits, stats
from ..operators.order import hash_bucket, numbered
from ..sources import store, tables, writers

SEED = 7
FOCUS = "PART"
BATCH = 512
FAN_OUT = [8, 3]
MOST_NODES = 2000
MOST_IMAGES = 100
CONTEXT = 4


class Graph:
    """The tables of one folder as a graph, each made when it is first asked for. The catalog and the triples are written
    to the shared folder, since most queries read them more than once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.nodes, self.edges = tables.nodes(spark, folder), tables.edges(spark, folder)

    _known: ClassVar[dict[tuple[str, str], tuple[tuple, Graph]]] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Graph:
        """The graph of a folder, made once a session: queries share its tables as long as the folder's files stay the same."""
        key, files = (spark.sparkContext.applicationId, folder), tables.state(spark, folder)
        if key not in cls._known or cls._known[key][0] != files:
            cls._known[key] = files, cls(spark, folder)
        return cls._known[key][1]

    @cached_property
    def catalog(self) -> DataFrame:
        return N.written(C.entities(self.nodes, FOCUS))

    @cached_property
    def ended(self) -> DataFrame:
        return N.written(C.known_ends(C.typed(self.edges), self.catalog))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return N.written(C.relations(self.ended))

    @cached_property
    def triples(self) -> DataFrame:
        return N.written(C.first_triples(self.ended, self.vocabulary).select("h", "r", "t"))

    @property
    def pairs(self) -> DataFrame:
        return self.triples.select(F.col("h").alias("src"), F.col("t").alias("dst"))

    @property
    def flagged(self) -> DataFrame:
        """Nodes by node_idx, with what contexts need."""
        return self.catalog.select(F.col("node_idx").alias("node_id"), "chunk_id", "chunk_pos", "is_art")

    @cached_property
    def _split(self) -> DataFrame:
        return splits.by_relation(self.triples, 0.1, 0.1, 30, SEED)

    def split(self) -> DataFrame:
        return self._split

    @property
    def train(self) -> DataFrame:
        return self.split().filter("split = 'train'").select("h", "r", "t")

    @cached_property
    def messages(self) -> DataFrame:
        """The train triples' message edges, stored as half as many links."""
        return N.both_ways(N.written(N.links(self.train)))

    @cached_property
    def store(self) -> store.GraphStore:
        """The train triples' message edges."""
        return store.GraphStore.create(self.messages, self.catalog.select(F.col("node_idx").alias("node"), "chunk_id"), SEED)

    @cached_property
    def seeds(self) -> DataFrame:
        """All nodes, BATCH a batch, in a hash order."""
        hashed = self.catalog.select(F.col("node_idx").alias("node")).withColumn("hash", order_hash(f"{SEED}:batch", "node"))
        placed = numbered(hashed, "place", hash_bucket("hash"), [F.col("hash"), F.col("node")])
        return N.dealt(placed.select(F.floor(F.col("place") / BATCH).cast("long").alias("batch_id"), "node"), "batch_id")

    @cached_property
    def sample(self) -> tuple[DataFrame, DataFrame]:
        return N.sampled(self.seeds, self.messages, FAN_OUT, 2, SEED)


def graph_totals(spark, folder):
    g = Graph.of(spark, folder)
    return stats.totals(g.nodes, g.edges)


def node_label_counts(spark, folder):
    return stats.label_counts(Graph.of(spark, folder).nodes)


def edge_type_counts(spark, folder):
    return stats.type_counts(C.typed(Graph.of(spark, folder).edges))


def entity_catalog(spark, folder):
    return C.entities(Graph.of(spark, folder).nodes, FOCUS)


def image_flags(spark, folder):
    """Any and all of the image lists' readings, and both readings of the label."""
    from ..functions.predicates import all_image_urls, any_image_url, has_label, has_label_any_case

    return Graph.of(spark, folder).nodes.groupBy(has_label("labels", FOCUS).alias("exact"), has_label_any_case("labels", FOCUS).alias("any_case"), any_image_url("images").alias("any_url"), all_image_urls("images").alias("all_urls")).agg(F.count("*").alias("n"))


def wid_lookup(spark, folder):
    return C.first_by_wid(Graph.of(spark, folder).catalog)


def relation_vocab(spark, folder):
    return Graph.of(spark, folder).vocabulary


def triples_dedup(spark, folder):
    g = Graph.of(spark, folder)
    return C.triples(g.edges, g.catalog)


def edge_endpoint_filter(spark, folder):
    """Edges by type before and after those with an end outside the first chunk are dropped."""
    g = Graph.of(spark, folder)
    kept = C.known_ends(C.typed(g.edges), g.catalog.filter("chunk_id = 0"))
    return C.typed(g.edges).groupBy("type").agg(F.count("*").alias("n")).join(kept.groupBy("type").agg(F.count("*").alias("kept")), "type", "left").select("type", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


def resolve_refs(spark, folder):
    """Events' references to nodes by wid, by number, and unknown ones."""
    user = (F.lit(4 * 10**10) + F.col("user_id")).cast("string")
    ref = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Q"), user)).when(F.col("event_id") % 3 == 1, user).otherwise("nobody")
    relation = F.element_at(F.array(F.lit("CONTAINS"), F.lit("3"), F.lit("nothing")), (F.col("event_id") % 3 + 1).cast("int"))
    refs = tables.table(spark, folder, "events").select("event_id", ref.alias("ref"), relation.alias("relation"))
    g = Graph.of(spark, folder)
    return C.resolved_relations(C.resolved_entities(refs, g.catalog), g.vocabulary).select("event_id", "node_idx", "r")


def art_subsets(spark, folder):
    """Triples by relation in each subset of flagged ends."""
    from ..operators.metrics import in_subsets

    g = Graph.of(spark, folder)
    return in_subsets(C.ends_flag(g.triples, g.catalog)).groupBy("subset", "r").agg(F.count("*").alias("n"))


def undirected_dedup(spark, folder):
    return N.undirected(Graph.of(spark, folder).pairs)


def propagation_edges(spark, folder):
    return N.propagation(Graph.of(spark, folder).triples)


def degree_distribution(spark, folder):
    g = Graph.of(spark, folder)
    return stats.degrees(g.nodes, g.edges).groupBy("degree").agg(F.count("*").alias("n"))


def csr_row_ptr(spark, folder):
    g = Graph.of(spark, folder)
    return stats.row_pointers(g.nodes, g.edges)


def chunk_shares(spark, folder):
    g = Graph.of(spark, folder)
    owners = g.nodes.select(F.col("node_id").alias("src"), "chunk_id")
    return stats.chunk_shares(g.edges.join(owners, "src")).withColumn("share", F.round("share", 6))


def chunk_plan(spark, folder):
    return stats.chunk_plan(Graph.of(spark, folder).nodes, 2000, 1000, 3000)


def chunk_manifest(spark, folder):
    g = Graph.of(spark, folder)
    return writers.manifest(g.nodes, g.edges)


def manifest_faults(spark, folder):
    """Faults of the planned chunks' manifest as it is, and as it would be with one chunk's count lost."""
    rows = stats.chunk_plan(Graph.of(spark, folder).nodes, 2000, 1000, 3000).select("chunk_index", "node_count", F.lit(0).alias("edge_count"), "low", "high")
    said = rows.agg(F.sum("node_count").alias("completed_nodes"), F.sum("edge_count").alias("completed_edges"))
    whole = rows.crossJoin(said)
    broken = whole.withColumn("node_count", F.when(F.col("chunk_index") == 0, 0).otherwise(F.col("node_count")))
    return stats.manifest_faults(whole).withColumn("manifest", F.lit("whole")).unionByName(stats.manifest_faults(broken).withColumn("manifest", F.lit("broken")))


def edge_lines(spark, folder):
    g = Graph.of(spark, folder)
    return writers.edge_lines(C.typed(g.edges), g.nodes).groupBy("src_type", "dst_type", "type").agg(F.count("*").alias("n"), F.min("src").alias("src"), F.max("dst").alias("dst"))


def export_resume(spark, folder):
    """Nodes an export has still to write after it has written the customers."""
    return writers.resumed(Graph.of(spark, folder).nodes, 5 * 10**10).select("node_id", "chunk_id")


def one_hop_neighbors(spark, folder):
    """All edges at parts, whichever way they point."""
    g = Graph.of(spark, folder)
    parts = tables.table(spark, folder, "part").select(tables.node_id("part", "p_partkey").alias("node"))
    return N.one_hop(parts, C.typed(g.edges)).groupBy("node", "type").agg(F.count("*").alias("n"), F.count_distinct("other").alias("others"))


def bfs_two_hop(spark, folder):
    """Nodes within two hops of the three lowest parts."""
    g = Graph.of(spark, folder)
    parts = tables.table(spark, folder, "part").select(tables.node_id("part", "p_partkey").alias("node")).orderBy("node").limit(3)
    return N.breadth_first(parts, g.edges, 2)


def bfs_subgraph(spark, folder):
    """The edges found by that search, each once, from the end reached first."""
    g = Graph.of(spark, folder)
    return N.bfs_edges(bfs_two_hop(spark, folder), C.typed(g.edges), 2)


def khop_sample(spark, folder):
    return Graph.of(spark, folder).sample[0]


def khop_edges(spark, folder):
    return Graph.of(spark, folder).sample[1]


def khop_trim(spark, folder):
    return N.trimmed(Graph.of(spark, folder).sample[0], MOST_NODES)


def image_trim(spark, folder):
    g = Graph.of(spark, folder)
    return N.trimmed_images(g.sample[0], g.catalog, MOST_IMAGES, SEED)


def induced_subgraph(spark, folder):
    nodes, edges = Graph.of(spark, folder).sample
    return N.induced(N.trimmed(nodes, MOST_NODES), edges)[1]


def leakage_mask(spark, folder):
    """The sample's edges without those between a seed and the seed's nation."""
    g = Graph.of(spark, folder)
    edges = g.sample[1]
    nation = g.vocabulary.filter("type = 'IN_NATION'").select("r")
    pairs = g.seeds.withColumnRenamed("node", "h").join(g.triples, "h").join(F.broadcast(nation), "r").select("batch_id", "h", "t")  # one row
    return N.masked(edges, pairs)


def intra_chunk_edges(spark, folder):
    g = Graph.of(spark, folder)
    return N.intra_chunk(g.edges, g.nodes).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("src_pos").alias("src_sum"), F.sum("dst_pos").alias("dst_sum"))


def cross_chunk_context(spark, folder):
    g = Graph.of(spark, folder)
    return N.cross_context(g.pairs, g.flagged, CONTEXT, SEED)


def split_relation_stratified(spark, folder):
    return Graph.of(spark, folder).split()


def split_unseen_repair(spark, folder):
    return splits.repaired(Graph.of(spark, folder).split())


def split_undirected(spark, folder):
    return splits.of_pairs(Graph.of(spark, folder).pairs, 0.8, 0.1, SEED)


def split_overlap(spark, folder):
    return splits.overlaps(split_undirected(spark, folder), ["lo", "hi"])


def epoch_batches(spark, folder):
    return splits.epoch_batches(Graph.of(spark, folder).triples, ["h", "r", "t"], BATCH, SEED, 1)


def _pairs(triples: DataFrame) -> DataFrame:
    return N.undirected(triples.select(F.col("h").alias("src"), F.col("t").alias("dst")))


def pool_of(catalog: DataFrame) -> DataFrame:
    rows = catalog.select(F.col("node_idx").alias("node"), "chunk_id", "chunk_pos")
    return N.written(numbered(rows, "place", F.col("chunk_id"), [F.col("chunk_pos"), F.col("node")]).select("place", "node"))


def neg_kge(spark, folder):
    g = Graph.of(spark, folder)
    return negatives.of_triples(g.triples, g.triples, g.catalog.count(), SEED)


def neg_uniform(spark, folder):
    g = Graph.of(spark, folder)
    pairs = N.dealt(_pairs(g.triples), "lo", "hi")
    return negatives.of_pairs(pairs, pairs, pool_of(g.catalog), SEED)


def neg_art(spark, folder):
    g = Graph.of(spark, folder)
    pairs = N.dealt(_pairs(g.triples), "lo", "hi")
    return negatives.of_pairs(pairs, pairs, pool_of(g.catalog.filter("is_art")), SEED, 100)


def neg_art_any(spark, folder):
    g = Graph.of(spark, folder)
    pairs = N.dealt(_pairs(g.triples), "lo", "hi")
    return negatives.of_pairs_any(pairs, pairs, pool_of(g.catalog.filter("is_art")), pool_of(g.catalog.filter("NOT is_art")), SEED)


def neg_candidate_pool(spark, folder):
    """From a small pool, the nations, in which most draws are known: some rows have none that is valid."""
    g = Graph.of(spark, folder)
    triples = g.triples
    nation = g.vocabulary.filter("type = 'IN_NATION'").select("r")
    positives = triples.join(F.broadcast(nation), "r")  # one row
    return negatives.of_pairs(_pairs(positives), _pairs(triples), pool_of(g.catalog.filter(F.col("node_id").between(2 * 10**10, 2 * 10**10 + 3))), SEED, 3)


QUERIES = {
    f.__name__: f
    for f in (
        graph_totals, node_label_counts, edge_type_counts, entity_catalog, image_flags, wid_lookup, relation_vocab, triples_dedup, edge_endpoint_filter, resolve_refs, art_subsets,
        undirected_dedup, propagation_edges, degree_distribution, csr_row_ptr, chunk_shares, chunk_plan, chunk_manifest, manifest_faults, edge_lines, export_resume,
        one_hop_neighbors, bfs_two_hop, bfs_subgraph, khop_sample, khop_edges, khop_trim, image_trim, induced_subgraph, leakage_mask, intra_chunk_edges, cross_chunk_context,
        split_relation_stratified, split_unseen_repair, split_undirected, split_overlap, epoch_batches, neg_kge, neg_uniform, neg_art, neg_art_any, neg_candidate_pool,
    )
}
