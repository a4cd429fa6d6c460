"""Queries on evaluation: samples, final tests, whole reports by split and subset, texts by item, values of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import claims
from ..functions.hashing import draw
from ..operators import evaluation as E
from ..operators import negatives, stats, texts
from ..operators import neighbours as N
from ..operators.catalog import ends_flag, subsets
from ..sources import tables
from .graph_queries import SEED, Graph, pool_of, split_undirected
from .graph_sql import ALL, GRAPH, PAIR_SPLIT, hash_sql
from .model_queries import DIGITS, _r
from .model_sql import auc_sql

MOST_EDGES = 500
NUM_NEG = 12
TRIES = 20
FINAL_TRIES = 3
SAMPLE = 2000
CELLS = [f"{split}:{subset}" for split in ("val", "test") for subset in ("global", "art_art", "art_any")]
METRICS = ("auc", "ap", "hit", "per_positive")


def _vectors(catalog: DataFrame) -> DataFrame:
    """Stored node vectors: four numbers that a hash of the node gives."""
    values = [(draw(201, f"11:{i}", "node") - 100) / 64.0 for i in range(4)]
    return catalog.select(F.col("node_idx").alias("node")).select("node", F.array(*values).alias("vector"))


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({c: _r(F.col(c)) for c in METRICS})


def chunk_sample(spark, folder):
    """Triples drawn without replacement from all chunks, each in proportion to its number."""
    g = Graph.of(spark, folder)
    owners = g.catalog.select(F.col("node_idx").alias("h"), "chunk_id")
    return E.sampled_rows(g.triples, ["h", "r", "t"], SAMPLE, f"{SEED}:eval").join(owners, "h").select("chunk_id", "h", "r", "t")


def chunk_focus_edges(spark, folder):
    g = Graph.of(spark, folder)
    return E.chunk_focus_edges(N.intra_chunk(g.edges, g.nodes), g.catalog)


def image_coverage(spark, folder):
    """Nodes' images, when every second part has a file."""
    parts = tables.table(spark, folder, "part").filter("p_partkey % 2 = 0")
    wid = F.concat(F.lit("Q"), tables.node_id("part", "p_partkey").cast("string"))
    return E.image_coverage(Graph.of(spark, folder).catalog, parts.select(wid.alias("wid"), F.lit("x.png").alias("path")))


def split_evaluation(spark, folder):
    """Validation and test pairs, at most MOST_EDGES of each subset, with NUM_NEG negatives each of the subset's own kind."""
    g = Graph.of(spark, folder)
    every = N.written(split_undirected(spark, folder))
    held = every.filter("split != 'train'").select(F.col("lo").alias("h"), F.col("hi").alias("t"), "split")
    placed = ends_flag(held, g.catalog).withColumn("subset", subsets(F.col("h_flag") & F.col("t_flag"), F.col("h_flag") | F.col("t_flag")))
    placed = placed.select(F.concat_ws(":", "split", "subset").alias("cell"), "subset", F.col("h").alias("lo"), F.col("t").alias("hi"))
    positives = N.written(E.sampled_rows(placed, ["lo", "hi"], MOST_EDGES, f"{SEED}:eval", "cell"))
    of = lambda subset: positives.filter(F.col("subset") == subset).select("lo", "hi")
    focus, known = pool_of(g.catalog.filter("is_art")), every.select("lo", "hi")
    ends = {"neg_lo": F.least("lo", "neg"), "neg_hi": F.greatest("lo", "neg")}
    drawn = {
        "global": negatives.of_pairs(of("global"), known, pool_of(g.catalog), SEED, TRIES, NUM_NEG).withColumns(ends),
        "art_art": negatives.of_pairs(of("art_art"), known, focus, SEED, TRIES, NUM_NEG).withColumns(ends),
        "art_any": negatives.of_pairs_any(of("art_any"), known, focus, pool_of(g.catalog.filter("NOT is_art")), SEED, TRIES, NUM_NEG),
    }
    found = None
    for subset, rows in drawn.items():
        rows = rows.filter("valid").select(F.lit(subset).alias("subset"), "lo", "hi", "neg_lo", "neg_hi")
        found = rows if found is None else found.unionByName(rows)
    found = found.join(positives, ["subset", "lo", "hi"])
    return _rounded(E.report(positives, found, _vectors(g.catalog), NUM_NEG, CELLS))


def final_test(spark, folder):
    """All test pairs from stored vectors, with negatives from a small pool, the nations: some have not all of theirs."""
    g = Graph.of(spark, folder)
    every = N.written(split_undirected(spark, folder))
    positives = every.filter("split = 'test'").select("lo", "hi")
    pool = pool_of(g.catalog.filter(F.col("node_id").between(2 * 10**10, 3 * 10**10 - 1)))
    drawn = negatives.of_pairs(positives, every.select("lo", "hi"), pool, SEED, FINAL_TRIES, NUM_NEG).filter("valid")
    drawn = drawn.withColumns({"cell": F.lit("test"), "neg_lo": F.least("lo", "neg"), "neg_hi": F.greatest("lo", "neg")})
    return _rounded(E.report(positives.withColumn("cell", F.lit("test")), drawn, _vectors(g.catalog), NUM_NEG, ["test"]))


def last_rolling_stats(spark, folder):
    out = stats.last_rolling(tables.table(spark, folder, "events"), "event_type", "event_id", "value", 20)
    return out.select("event_type", "n", *[_r(F.col(c)).alias(c) for c in ("mean", "std", "var")])


def _texts(spark, folder) -> DataFrame:
    """Documents as texts of shards; items repeat in them, and some rows name none."""
    d = tables.table(spark, folder, "documents")
    wid = F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("Q"), (F.col("doc_id") % 97).cast("string"))).otherwise("")
    return d.select(wid.alias("wid"), F.floor(F.col("doc_id") / 50).alias("chunk"), (F.col("doc_id") % 50).alias("position"), F.coalesce("text", F.lit("")).alias("text"))


def text_index(spark, folder):
    return texts.text_index(_texts(spark, folder))


def text_lookup(spark, folder):
    """Items' texts in the first three chunks alone."""
    t = _texts(spark, folder)
    wanted = spark.range(120).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("wid"))
    found = texts.looked_up(wanted, texts.of_chunks(t, spark.range(3).withColumnRenamed("id", "chunk")))
    return found.select("wid", F.md5(F.col("text").cast("binary")).alias("md5"))


def claim_values(spark, folder):
    """Claims made of parts: several statements, preferred ones, values of other kinds, and none."""
    key = F.col("p_partkey").cast("string")
    statement = lambda rank, value: F.concat(F.lit('{"rank":"'), F.lit(rank), F.lit('","mainsnak":{"datavalue":{"value":'), value, F.lit("}}}"))
    time = F.concat(F.lit('{"time":"+'), F.col("p_size") + 1000, F.lit('-01-01T00:00:00Z","precision":'), F.when(F.col("p_size") % 3 == 0, '"9"').otherwise("9"), F.lit("}"))
    place = F.concat(F.lit('{"latitude":'), (F.col("p_size") / 4.0).cast("string"), F.lit(',"longitude":'), F.when(F.col("p_size") % 5 == 0, "null").otherwise((-F.col("p_size")).cast("string")), F.lit("}"))
    item = F.concat(F.lit('{"id":"Q'), key, F.lit('"}'))
    other = F.concat(F.lit('{"id":"Q0'), key, F.lit('"}'))
    string = F.when(F.col("p_size") % 4 == 0, item).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    second = F.when(F.col("p_size") % 2 == 0, "preferred").otherwise("normal")
    pair = F.concat(F.lit("["), statement("normal", item), F.lit(',{"rank":"'), second, F.lit('","mainsnak":{"datavalue":{"value":'), other, F.lit("}}}]"))
    one = lambda value: F.concat(F.lit("["), statement("normal", value), F.lit("]"))
    entity = F.concat(F.lit('{"claims":{"P1":'), one(time), F.lit(',"P625":'), one(place), F.lit(',"P2":'), pair, F.lit(',"P3":'), one(string), F.lit(',"P4":[]}}'))
    e = F.parse_json(entity)
    t, c = claims.claim_time(e, "P1"), claims.claim_coordinate(e)
    return tables.table(spark, folder, "part").select("p_partkey", t["time"].alias("time"), t["precision"].alias("precision"), c["latitude"].alias("latitude"), c["longitude"].alias("longitude"), claims.claim_item(e, "P2").alias("item"), claims.claim_string(e, "P3").alias("string"), claims.claim_item(e, "P4").alias("nothing"))


QUERIES = {f.__name__: f for f in (chunk_sample, chunk_focus_edges, image_coverage, split_evaluation, final_test, last_rolling_stats, text_index, text_lookup, claim_values)}

_VEC = f"vec AS (SELECT node_idx AS node, [{', '.join(f'({hash_sql(f"{chr(39)}11:{i}{chr(39)}", "node_idx")} % 201 - 100) / 64.0::DOUBLE' for i in range(4))}] AS v FROM catalog)"
_POOL = lambda name, where: f"{name} AS (SELECT row_number() OVER (ORDER BY chunk_id, chunk_pos, node_idx) - 1 AS place, node_idx AS node FROM catalog WHERE {where})"
_PLACE = lambda seed, pool: f"{hash_sql(seed, 'c.lo', 'c.hi', 'copy', 'k')} % greatest((SELECT count(*) FROM {pool}), 1)"
_ONE_END = lambda name, pool, subset, tries: f"""{name} AS (SELECT cell, lo, hi, copy, k, least(lo, node) AS neg_lo, greatest(lo, node) AS neg_hi
    FROM (SELECT c.*, k, {_PLACE("'7'", pool)} AS place FROM copies c, range({tries}) AS x(k) WHERE cell LIKE '%{subset}') JOIN {pool} USING (place))"""  # noqa: E731
_REPORT = f"""good AS (SELECT cell, lo, hi, copy, arg_min(neg_lo, k) AS neg_lo, arg_min(neg_hi, k) AS neg_hi FROM draws d WHERE neg_lo <> neg_hi
    AND NOT EXISTS (SELECT 1 FROM pairs z WHERE z.lo = d.neg_lo AND z.hi = d.neg_hi) GROUP BY cell, lo, hi, copy),
goals AS (SELECT cell, lo, hi, list_dot_product(a.v, b.v) AS goal FROM pos JOIN vec a ON a.node = lo JOIN vec b ON b.node = hi),
negs AS (SELECT cell, lo, hi, list_dot_product(a.v, b.v) AS score FROM good JOIN vec a ON a.node = neg_lo JOIN vec b ON b.node = neg_hi),
ranks AS (SELECT cell, lo, hi, count(*) AS n, 1 + count(*) FILTER (score >= goal) AS rank FROM negs JOIN goals USING (cell, lo, hi) GROUP BY ALL),
hits AS (SELECT cell, count(*) AS hit_pos, avg((rank <= 10)::INTEGER) AS hit FROM ranks WHERE n = {NUM_NEG} GROUP BY cell),
labelled AS (SELECT cell, goal AS score, 1 AS label FROM goals UNION ALL SELECT cell, score, 0 FROM negs),
areas AS (WITH {auc_sql('cell', 'labelled')})
SELECT cell, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, coalesce(auc, 0.0) AS auc, coalesce(ap, 0.0) AS ap, coalesce(hit_pos, 0) AS hit_pos,
    round(coalesce(hit, 0.0), {DIGITS}) + 0.0 AS hit, round(coalesce(n_neg / greatest(n_pos, 1), 0.0), {DIGITS}) + 0.0 AS per_positive FROM cells_ LEFT JOIN areas USING (cell) LEFT JOIN hits USING (cell)"""

SQL = {
    "chunk_sample": f"WITH {ALL}, drawn AS (SELECT h, r, t FROM triples ORDER BY {hash_sql("'7:eval'", 'h', 'r', 't')}, h, r, t LIMIT {SAMPLE}) SELECT chunk_id, h, r, t FROM drawn JOIN catalog ON node_idx = h",
    "chunk_focus_edges": f"""WITH {GRAPH} SELECT a.chunk_id, count(*) AS edges, count(*) FILTER (trim(a.label) = 'PART' AND trim(b.label) = 'PART') AS art_art,
        count(*) FILTER (trim(a.label) = 'PART' OR trim(b.label) = 'PART') AS art_any FROM raw_edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.chunk_id = b.chunk_id GROUP BY a.chunk_id""",
    "image_coverage": f"""WITH {ALL}, there AS (SELECT *, has_image AND node_id // 10000000000 = 5 AND node_id % 2 = 0 AS file FROM catalog)
        SELECT count(*) FILTER (file) AS hit, count(*) FILTER (NOT has_image) AS none, count(*) FILTER (has_image AND NOT file) AS missing FROM there""",
    "split_evaluation": f"""WITH {PAIR_SPLIT},
        flagged AS (SELECT split, lo, hi, a.is_art AS af, b.is_art AS bf FROM split JOIN catalog a ON a.node_idx = lo JOIN catalog b ON b.node_idx = hi WHERE split <> 'train'),
        parts AS (SELECT split || ':global' AS cell, lo, hi FROM flagged UNION ALL SELECT split || ':art_art', lo, hi FROM flagged WHERE af AND bf UNION ALL SELECT split || ':art_any', lo, hi FROM flagged WHERE af OR bf),
        pos AS (SELECT cell, lo, hi FROM parts QUALIFY row_number() OVER (PARTITION BY cell ORDER BY {hash_sql("'7:eval'", 'lo', 'hi')}, lo, hi) <= {MOST_EDGES}),
        cells_ AS (SELECT unnest({CELLS}) AS cell), {_VEC}, {_POOL('everyone', 'TRUE')}, {_POOL('focus', 'is_art')}, {_POOL('rest', 'NOT is_art')},
        copies AS (SELECT cell, lo, hi, copy FROM pos, range({NUM_NEG}) AS y(copy)),
        {_ONE_END('uniform', 'everyone', ':global', TRIES)}, {_ONE_END('art', 'focus', ':art_art', TRIES)},
        places AS (SELECT c.*, k, {hash_sql("'7:side'", 'c.lo', 'c.hi', 'copy')} % 2 = 0 AS both_drawn, {_PLACE("'7'", 'focus')} AS x, {_PLACE("'7:other'", 'rest')} AS y FROM copies c, range({TRIES}) AS z(k) WHERE cell LIKE '%:art_any'),
        ends AS (SELECT cell, lo, hi, copy, k, f.node AS art, CASE WHEN both_drawn THEN o.node ELSE lo END AS other FROM places JOIN focus f ON f.place = x JOIN rest o ON o.place = y),
        draws AS (SELECT * FROM uniform UNION ALL SELECT * FROM art UNION ALL SELECT cell, lo, hi, copy, k, least(art, other), greatest(art, other) FROM ends), {_REPORT}""",
    "final_test": f"""WITH {PAIR_SPLIT}, pos AS (SELECT 'test' AS cell, lo, hi FROM split WHERE split = 'test'), cells_ AS (SELECT 'test' AS cell), {_VEC}, {_POOL('nations', 'node_id // 10000000000 = 2')},
        copies AS (SELECT cell, lo, hi, copy FROM pos, range({NUM_NEG}) AS y(copy)), {_ONE_END('draws', 'nations', 'test', FINAL_TRIES)}, {_REPORT}""",
    "last_rolling_stats": f"""SELECT event_type, count(value) AS n, round(avg(value), {DIGITS}) + 0.0 AS mean, round(stddev_pop(value), {DIGITS}) + 0.0 AS std, round(var_pop(value), {DIGITS}) + 0.0 AS var
        FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20) GROUP BY event_type""",
    "text_index": "SELECT 'Q' || doc_id % 97 AS wid, max(doc_id) // 50 AS chunk, max(doc_id) % 50 AS position FROM documents WHERE doc_id % 10 > 0 GROUP BY 1",
    "text_lookup": """SELECT 'Q' || id AS wid, md5(coalesce(text, '')) AS md5 FROM range(120) AS x(id)
        LEFT JOIN (SELECT doc_id % 97 AS id, arg_max(coalesce(text, ''), doc_id) AS text FROM documents WHERE doc_id % 10 > 0 AND doc_id < 150 GROUP BY 1) USING (id)""",
    "claim_values": """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN '+' || (p_size + 1000) || '-01-01T00:00:00Z' END AS time, CASE WHEN p_size % 3 > 0 THEN 9 END AS precision,
        CASE WHEN p_size % 5 > 0 THEN p_size / 4.0::DOUBLE END AS latitude, CASE WHEN p_size % 5 > 0 THEN -p_size::DOUBLE END AS longitude,
        CASE WHEN p_size % 2 = 0 THEN 'Q0' ELSE 'Q' END || p_partkey AS item, CASE WHEN p_size % 4 > 0 THEN p_partkey::VARCHAR END AS string, NULL::VARCHAR AS nothing FROM part""",
}
