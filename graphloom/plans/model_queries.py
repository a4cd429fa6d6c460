"""Queries on vectors and scores, texts and fetch records, event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..functions.articles import article_sections
from ..functions.hashing import draw, order_hash
from ..functions.predicates import is_bad_section, is_terminal, is_wid
from ..operators import catalog as C
from ..operators import encoding, ledger, messages, metrics, stats
from ..operators.neighbours import written
from ..operators.splits import first_rows
from ..sources import tables

SEED = 11
DIGITS = 6
NEGATIVES = 20
#: Fixed weights of the small layers that the queries apply.
OWN = [[0.5, -0.25, 0.125, 1.0] * 16, [1.0, 0.5, -0.5, 0.25] * 16]
NEIGHBOUR = [[0.25, 0.5, -1.0, 0.125] * 16, [-0.5, 1.0, 0.25, 0.5] * 16]
BIAS = [0.1, -0.2]


def _r(c) -> F.Column:
    return F.round(c, DIGITS) + 0.0


class Vectors:
    """The embeddings as entities, and their labels' centroids as relations. A query pair is an entity and one that a hash
    draws for it; its relation is the entity's label."""

    def __init__(self, spark: SparkSession, folder: str, graph: bool = False):
        self.plain = self.entities = tables.vectors(spark, folder)
        self.n = self.plain.count()
        if graph:  # entities as a graph encoder sees them
            encoded = messages.encoder("blend")(self.edges, self.plain.select("node", "vector"))
            self.entities = written(encoded.join(self.plain.select("node", "label"), "node"))

    @property
    def relations(self) -> DataFrame:
        return messages.mean_vectors(self.plain, ["label"]).withColumnRenamed("label", "r")

    def other(self, *key: str):
        return draw(self.n, SEED, *key)

    @property
    def queries(self) -> DataFrame:
        return self.entities.select(F.col("node").alias("qid"), F.col("node").alias("h"), self.other("node").alias("t"), F.col("label").alias("r"))

    @property
    def known(self) -> DataFrame:
        """The queries' triples, and the next relation of every second pair."""
        rows = self.queries.select("h", "t", "r")
        return rows.unionByName(rows.filter("h % 2 = 0").withColumn("r", ((F.col("r") + 1) % 10).cast("int")))

    @property
    def edges(self) -> DataFrame:
        """Five edges of each entity, of three relations."""
        return self.entities.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("src", self.other("src", "k").alias("dst"), (F.col("k") % 3).alias("rel")).distinct()

    def labelled(self, scorer: str) -> DataFrame:
        """Each query's triple (label 1) and NEGATIVES with other tails (label 0), scored."""
        tails = self.queries.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(NEGATIVES)))).select("qid", "h", "r", self.other("h", "k").alias("t"), F.lit(0).alias("label"))
        rows = self.queries.select("qid", "h", "r", "t", F.lit(1).alias("label")).unionByName(tails)
        return metrics.scored(rows, self.entities, self.relations, scorer)

    def candidates(self, scorer: str) -> DataFrame:
        return metrics.score_lists(self.queries, self.entities, self.relations, scorer)

    def subsets(self, rows: DataFrame, ends: DataFrame) -> DataFrame:
        """rows (qid, …) in subsets; an entity of an even label is flagged."""
        flags = self.entities.select("node", (F.col("label") % 2 == 0).alias("flag"))
        h = flags.select(F.col("node").alias("h"), F.col("flag").alias("h_flag"))
        t = flags.select(F.col("node").alias("t"), F.col("flag").alias("t_flag"))
        return metrics.in_subsets(rows.join(ends.select("qid", "h", "t").join(h, "h").join(t, "t").select("qid", "h_flag", "t_flag"), "qid"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vector").alias("dim", "x")).withColumn("x", _r(F.col("x")))


def relation_centroids(spark, folder):
    return _spread(Vectors(spark, folder).relations, "r")


def _scores(spark, folder, scorer):
    v = Vectors(spark, folder)
    return metrics.scored(v.queries, v.entities, v.relations, scorer).withColumn("score", _r(F.col("score")))


def transe_scores(spark, folder):
    return _scores(spark, folder, "transe")


def complex_scores(spark, folder):
    return _scores(spark, folder, "complex")


def relation_topk(spark, folder):
    v = Vectors(spark, folder)
    return metrics.top_relations(v.candidates("complex"), 3).select("qid", "r", "rank", _r(F.col("score")).alias("score"))


def relation_rank_filtered(spark, folder):
    v = Vectors(spark, folder)
    return metrics.filtered_ranks(v.candidates("transe"), v.known)


def relation_topk_graph(spark, folder):
    """relation_topk over graph-encoded entities."""
    v = Vectors(spark, folder, graph=True)
    return metrics.top_relations(v.candidates("complex"), 3).select("qid", "r", "rank", _r(F.col("score")).alias("score"))


def relation_rank_graph(spark, folder):
    """relation_rank_filtered over graph-encoded entities."""
    v = Vectors(spark, folder, graph=True)
    return metrics.filtered_ranks(v.candidates("transe"), v.known)


def triple_auc_ap_graph(spark, folder):
    """triple_auc_ap over graph-encoded entities."""
    out = metrics.auc_ap(Vectors(spark, folder, graph=True).labelled("transe"), "r")
    return out.select("r", "n_pos", "n_neg", _r(F.col("auc")).alias("auc"), _r(F.col("ap")).alias("ap"))


def mrr_hits(spark, folder):
    v = Vectors(spark, folder)
    ranks = v.subsets(metrics.filtered_ranks(v.candidates("transe"), v.known), v.queries)
    out = metrics.ranking(ranks, "subset")
    return out.select("subset", "n", *[_r(F.col(c)).alias(c) for c in ("mrr", "hits_1", "hits_3", "hits_10", "top1")])


def triple_auc_ap(spark, folder):
    out = metrics.auc_ap(Vectors(spark, folder).labelled("transe"), "r")
    return out.select("r", "n_pos", "n_neg", _r(F.col("auc")).alias("auc"), _r(F.col("ap")).alias("ap"))


def subset_metrics(spark, folder):
    v = Vectors(spark, folder)
    out = metrics.for_all_subsets(metrics.auc_ap(v.subsets(v.labelled("transe"), v.queries), "subset"), n_pos=0, n_neg=0, auc=0.0, ap=0.0)
    return out.select("subset", "n_pos", "n_neg", _r(F.col("auc")).alias("auc"), _r(F.col("ap")).alias("ap"))


def hit_at_10(spark, folder):
    v = Vectors(spark, folder)
    out = metrics.hit_at(v.subsets(v.labelled("transe"), v.queries), 10, "subset")
    return out.select("subset", "n", _r(F.col("hit")).alias("hit"))


def triple_loss(spark, folder):
    """Mean cross entropy of the scores by relation."""
    rows = Vectors(spark, folder).labelled("complex")
    return rows.groupBy("r").agg(_r(F.avg(V.logit_loss("score", "label"))).alias("loss"))


def mean_aggregate(spark, folder):
    v = Vectors(spark, folder)
    return _spread(messages.mean_aggregate(v.edges, v.entities), "node")


def relational_mean_aggregate(spark, folder):
    v = Vectors(spark, folder)
    return _spread(messages.relational_aggregate(v.edges, v.entities), "node", "rel")


def sage_layer(spark, folder):
    v = Vectors(spark, folder)
    return _spread(messages.sage_layer(v.edges, v.entities.select("node", "vector"), OWN, NEIGHBOUR, BIAS), "node")


def relational_layer(spark, folder):
    v = Vectors(spark, folder)
    shares = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-0.25, 2.0])], "rel int, share array<double>")
    return _spread(messages.relational_layer(v.edges, v.entities.select("node", "vector"), OWN, [OWN, NEIGHBOUR], shares, BIAS), "node")


def pair_scores(spark, folder):
    """A link's score from both ends' vectors by one hidden layer."""
    v = Vectors(spark, folder)
    short = v.entities.select("node", "vector")
    rows = v.queries.join(short.withColumnsRenamed({"node": "h", "vector": "x"}), "h").join(short.withColumnsRenamed({"node": "t", "vector": "y"}), "t")
    hidden = [[*a, *b] for a, b in zip(OWN, NEIGHBOUR, strict=True)]
    return rows.select("qid", _r(V.pair_score("x", "y", hidden, BIAS, [1.5, -0.5], 0.25)).alias("score"))


def fused_features(spark, folder):
    """Text vector and image vector in one layer; every third entity has no image."""
    v = Vectors(spark, folder)
    rows = v.entities.select("node", F.slice("vector", 1, 40).alias("text"), F.when(F.col("node") % 3 > 0, F.slice("vector", 41, 23)).alias("image"))
    return _spread(rows.select("node", V.fused("text", "image", [0.75] * 23, OWN, BIAS).alias("vector")), "node")


def text_vectors(spark, folder):
    """A vector of every document's text without a model: its words in 8 buckets."""
    docs = tables.table(spark, folder, "documents")
    return _spread(docs.select(F.col("doc_id").alias("node"), V.hashed_bag("text", 8).alias("vector")), "node")


def embedding_fill(spark, folder):
    """A vector for every document: its embedding if there is one, else one made of its text."""
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("node"), "text")
    cache = tables.vectors(spark, folder).select("node", "vector")
    found = ledger.filled(docs, cache, lambda rows: rows.select("node", V.hashed_bag("text", 64).alias("vector")))
    return found.select("node", _r(V.total(F.col("vector"))).alias("sum"))


def pair_encoding(spark, folder):
    """Scores of pairs of entities encoded once: the documents' texts, embeddings as images (every third entity has none), and
    the mean of neighbours; half of the vectors come from a cache."""
    v = Vectors(spark, folder)
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("node"), "text")
    entities = v.plain.join(docs, "node", "left").select("node", "text", F.when(F.col("node") % 3 > 0, F.slice("vector", 1, 4)).alias("image"))
    chain = encoding.Chain(size=8, missing=(0.75, 0.0, -0.5, 0.25))
    wanted = written(encoding.ends(v.queries))
    cache = written(chain.encode(wanted.filter("node % 2 = 0"), entities, v.edges))
    vectors = encoding.with_cache(wanted, cache, lambda missing: chain.encode(missing, entities, v.edges))
    pairs = encoding.gathered(v.queries.select("qid", "h", "t"), vectors)
    return pairs.select("qid", "h", "t", _r(V.dot("h_vector", "t_vector")).alias("score"))


def cache_hits(spark, folder):
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("node"))
    return ledger.hit_rate(docs, tables.vectors(spark, folder)).withColumn("rate", _r(F.col("rate")))


def text_clean(spark, folder):
    """Every document's text, a citation and odd white space put to it, and cleaned."""
    cleaned = TX.clean_text(F.concat(F.lit(" \t[12]"), F.coalesce("text", F.lit("")), F.lit("\n\n end[3] ")))
    return tables.table(spark, folder, "documents").select("doc_id", F.length(cleaned).alias("n"), F.md5(cleaned.cast("binary")).alias("md5"))


def text_assemble(spark, folder):
    """Brief and sections of records made of documents: the text, its language, a blank one."""
    sections = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("  "), F.lit("c"), F.concat(F.lit(" "), F.col("source")))
    text = TX.assemble_text("text", sections)
    return tables.table(spark, folder, "documents").select("doc_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("md5"))


def html_sections(spark, folder):
    """Brief and sections of every page, its article put where a wiki page has it; on pages of an even number its headline
    is made the heading of a section. Sections are JSON in the order of their titles."""
    inner = F.regexp_extract("html", r"(?s)<article[^>]*>(.*)</article>", 1)
    headed = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(inner, "(</?)h1", "$1h2")).otherwise(inner)
    page = F.concat(F.lit('<div id="mw-content-text"><div class="mw-parser-output">'), headed, F.lit("</div></div>"))
    rows = tables.table(spark, folder, "pages").select("page_id", article_sections(page).alias("x"))
    return rows.select("page_id", F.col("x.brief").alias("brief"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("x.sections")))).alias("sections"))


def time_format(spark, folder):
    """Order dates as times of changing sign and precision, as text."""
    o = tables.table(spark, folder, "orders")
    time = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    time = F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise(time)
    return o.select("o_orderkey", TX.format_time(time, F.col("o_orderkey") % 7 + 6).alias("text"))


def fallback_brief(spark, folder):
    """Sentences on parts from what is known of each."""
    some = lambda k, c: F.when(F.col("p_partkey") % k > 0, c)
    size = F.col("p_size").cast("string")
    brief = TX.fallback_brief(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")), some(7, F.concat(F.col("p_name"), F.lit(".."))), some(3, F.col("p_type")), some(4, size), some(5, size), some(6, F.col("p_brand")), some(2, size), some(8, F.col("p_brand")), some(3, F.col("p_size") / 8.0), F.col("p_size") / -4.0)
    return tables.table(spark, folder, "part").select("p_partkey", brief.alias("brief"))


def image_files(spark, folder):
    """File names of events' addresses, and the addresses' items."""
    e = tables.table(spark, folder, "events")
    end = F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".tiff", ".svg", "", ".gif"))), (F.col("event_id") % 6 + 1).cast("int"))
    url = F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("http://img/"), F.col("event_id").cast("string"), end)).otherwise("")
    wid = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("Q"), F.col("user_id").cast("string"), F.lit("_2")))
    return e.select("event_id", TX.image_file(wid, "user_id", url).alias("file"), TX.wid_of_stem(wid).alias("wid"), TX.slug(F.concat(F.lit(" /org\\"), F.col("event_type"), F.lit("/v 1.0/"))).alias("slug"), TX.title_url(F.concat(F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string")), "https://x/").alias("page"), TX.duration(F.col("user_id") * 61).alias("took"), TX.chunk_number(F.concat(F.when(F.col("event_id") % 2 == 0, "chunk_").otherwise("part_"), F.col("user_id").cast("string"), F.lit("_x"))).alias("chunk"))


def _records(spark, folder) -> DataFrame:
    """Events as fetch records of users."""
    e = tables.table(spark, folder, "events")
    status = F.element_at(F.array(F.lit("ok"), F.lit("no_sitelink"), F.lit("error"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("wid"), F.col("event_id").alias("pos"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("url"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise(" ").alias("brief"))


def _wanted(spark, folder) -> DataFrame:
    return tables.table(spark, folder, "customer").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("wid"), F.col("c_custkey").alias("pos"))


def latest_record_per_key(spark, folder):
    return C.latest(_records(spark, folder), "wid", "pos")


def terminal_flags(spark, folder):
    r = _records(spark, folder)
    return r.select("pos", is_terminal("status", "url", "brief").alias("terminal"), is_wid("wid").alias("item"), is_bad_section(F.concat(F.lit(" See  "), F.when(F.col("pos") % 2 == 0, "ALSO ").otherwise("all"))).alias("dropped"))


def pending_work(spark, folder):
    return ledger.pending(_wanted(spark, folder), _records(spark, folder))


def text_outputs(spark, folder):
    return ledger.outputs(_wanted(spark, folder), _records(spark, folder))


def ordered_distinct(spark, folder):
    return C.first_seen(tables.table(spark, folder, "events").select("user_id", "event_id"), "user_id", "event_id")


def best_path_pick(spark, folder):
    e = tables.table(spark, folder, "events")
    user = F.concat(F.lit("Q"), F.col("user_id").cast("string"))
    end = F.element_at(F.array(F.lit(".jpg"), F.lit("_0.png"), F.lit("_3.jpg"), F.concat(F.lit("_"), F.col("event_id").cast("string"), F.lit(".webp"))), (F.col("event_id") % 4 + 1).cast("int"))
    return C.best_path(e.select(user.alias("wid"), F.concat(F.lit("/img/"), F.col("event_type"), F.lit("/"), user, end).alias("path")))


def preferred_statement(spark, folder):
    """Of each user's events the first marked as preferred, else the first."""
    e = tables.table(spark, folder, "events")
    # Aggregated before it is shuffled, however many events a user has.
    return e.groupBy("user_id").agg(F.min(F.struct(F.col("event_id") % 7 != 0, "event_id"))["event_id"].alias("event_id"))


def rolling_stats(spark, folder):
    out = stats.rolling(tables.table(spark, folder, "events"), "event_type", "event_id", "value", 20)
    return out.select("event_type", "event_id", *[_r(F.col(c)).alias(c) for c in ("mean", "std", "var")])


def early_stop_trace(spark, folder):
    """Each event type's mean value by day as a run's evaluations."""
    day = F.unix_date(F.to_date("ts")).cast("long")
    runs = tables.table(spark, folder, "events").groupBy("event_type", day.alias("day")).agg(F.round(F.avg("value"), DIGITS).alias("metric"))
    return stats.early_stop(runs, "event_type", "day", "metric", 0.5, 5)


def eval_first_rows(spark, folder):
    """The first 1000 events of an evaluation."""
    return first_rows(tables.table(spark, folder, "events").select("event_id", "user_id"), ["event_id"], 1000)


def seed_pick(spark, folder):
    """The 50 customers first in the order of id times seed, which is that of the ids, and first in a hash order."""
    c = tables.table(spark, folder, "customer").select("c_custkey")
    plain = c.orderBy(F.col("c_custkey") * SEED, "c_custkey").limit(50).withColumn("how", F.lit("product"))
    hashed = c.orderBy(order_hash(SEED, "c_custkey"), "c_custkey").limit(50).withColumn("how", F.lit("hash"))
    return plain.unionByName(hashed)


def work_batches(spark, folder):
    """Customers in batches of 100 of their chunk's order."""
    from pyspark.sql.window import Window

    rows = tables.table(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 1000).alias("chunk"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("c_custkey")) - 1
    return rows.select("c_custkey", "chunk", F.floor(place / 100).alias("batch"))


QUERIES = {
    f.__name__: f
    for f in (
        relation_centroids, transe_scores, complex_scores, relation_topk, relation_rank_filtered, relation_topk_graph, relation_rank_graph, triple_auc_ap_graph, mrr_hits, triple_auc_ap, subset_metrics, hit_at_10, triple_loss,
        mean_aggregate, relational_mean_aggregate, sage_layer, relational_layer, pair_scores, fused_features, text_vectors, embedding_fill, pair_encoding, cache_hits,
        text_clean, text_assemble, html_sections, time_format, fallback_brief, image_files, latest_record_per_key, terminal_flags, pending_work, text_outputs, ordered_distinct,
        best_path_pick, preferred_statement, rolling_stats, early_stop_trace, eval_first_rows, seed_pick, work_batches,
    )
}
