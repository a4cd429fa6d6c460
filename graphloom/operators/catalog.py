"""Tables of a graph: entities with flags, relation vocabulary, typed triples, references resolved.

Raw nodes have node_id, chunk_id, chunk_pos, wid, labels (array) and images (array); raw edges have id (their place in
scan order), src, dst and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import any_image_url, has_label
from .order import numbered


#: Rows of a vocabulary that a join sends to all tasks; a larger one is shuffled.
MOST_SENT = 100_000


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df with a hint to broadcast it, if it has no more than `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def entities(nodes: DataFrame, focus: str = "ART") -> DataFrame:
    """node_idx, node_id, wid, has_image, is_art, chunk_id, chunk_pos: node_idx counts nodes by chunk and place in it."""
    rows = nodes.select("node_id", F.coalesce("wid", F.lit("")).alias("wid"), any_image_url("images").alias("has_image"), has_label("labels", focus).alias("is_art"), "chunk_id", "chunk_pos")
    return numbered(rows, "node_idx", F.col("chunk_id"), [F.col("chunk_pos"), F.col("node_id")]).select("node_idx", *rows.columns)


def first_by_wid(catalog: DataFrame) -> DataFrame:
    """(wid, node_idx): of several entities with one wid the first counts; an empty wid names none."""
    return catalog.filter("wid != ''").groupBy("wid").agg(F.min("node_idx").alias("node_idx"))


def typed(edges: DataFrame) -> DataFrame:
    """Edges whose trimmed type isn't blank."""
    return edges.withColumn("type", F.trim("type")).filter("type != ''")


def known_ends(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edges (id, type, h, t) both of whose ends are in the catalog, by node_idx. Of repeated node ids the last counts."""
    ids = catalog.groupBy("node_id").agg(F.max("node_idx").alias("node_idx"))
    heads = ids.select(F.col("node_id").alias("src"), F.col("node_idx").alias("h"))
    tails = ids.select(F.col("node_id").alias("dst"), F.col("node_idx").alias("t"))
    return edges.join(heads, "src").join(tails, "dst").select("id", "type", "h", "t")


def relations(edges: DataFrame) -> DataFrame:
    """(type, r): relation types numbered by their first appearance. A graph has few types, so their list is small."""
    first = edges.groupBy("type").agg(F.min("id").alias("first"))
    return first.select("type", (F.row_number().over(Window.orderBy("first", "type")) - 1).cast("int").alias("r"))


def triples(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(h, r, t, pos): typed edges with known ends, one for each (h, r, t): the first. pos is its place in scan order."""
    ended = known_ends(typed(edges), catalog)
    return first_triples(ended, relations(ended))


def first_triples(ended: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(h, r, t, pos) of edges with known ends, by a vocabulary of relations."""
    return ended.join(sent(vocabulary), "type").groupBy("h", "r", "t").agg(F.min("id").alias("pos"))


def resolved_entities(refs: DataFrame, catalog: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with node_idx: by wid, else by number; null if neither is known."""
    by_wid = first_by_wid(catalog).select(F.col("wid").alias(ref), F.col("node_idx").alias("by_wid"))
    by_id = catalog.groupBy("node_id").agg(F.max("node_idx").alias("by_id"))
    out = refs.join(by_wid, ref, "left").withColumn("node_id", F.col(ref).try_cast("long")).join(by_id, "node_id", "left")
    return out.select(*refs.columns, F.coalesce("by_wid", "by_id").alias("node_idx"))


def resolved_relations(refs: DataFrame, vocabulary: DataFrame, ref: str = "relation") -> DataFrame:
    """refs with r: by name, else by number; null if neither is known."""
    names = vocabulary.select(F.col("type").alias(ref), F.col("r").alias("by_name"))
    numbers = vocabulary.select(F.col("r").alias("number"), F.col("r").alias("by_number"))
    out = refs.join(names, ref, "left").withColumn("number", F.col(ref).try_cast("int")).join(numbers, "number", "left")
    return out.select(*refs.columns, F.coalesce("by_name", "by_number").alias("r"))


def ends_flag(triples_: DataFrame, catalog: DataFrame, flag: str = "is_art") -> DataFrame:
    """triples with h_flag and t_flag."""
    flags = catalog.select("node_idx", F.col(flag).alias("flag"))
    h = flags.select(F.col("node_idx").alias("h"), F.col("flag").alias("h_flag"))
    t = flags.select(F.col("node_idx").alias("t"), F.col("flag").alias("t_flag"))
    return triples_.join(h, "h").join(t, "t")


def subsets(both: Column, any_: Column) -> Column:
    """The names of the subsets a row with flagged ends is in: all rows, both ends, any end."""
    names = F.array(F.lit("global"), F.when(both, "art_art"), F.when(any_, "art_any"))
    return F.explode(F.filter(names, lambda x: x.isNotNull()))


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Different keys with the place at which each comes first."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def latest(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key: of several of one place, the greatest by its other columns (maps as JSON)."""
    rest = [c for c in df.columns if c not in (key, pos)]
    rank = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes if c in rest]
    last = df.groupBy(key).agg(F.max_by(F.struct(pos, *rest), F.struct(pos, *rank)).alias("row"))
    return last.select(key, *[F.col(f"row.{c}").alias(c) for c in (pos, *rest)])


def best_path(images: DataFrame, wid: str = "wid", path: str = "path") -> DataFrame:
    """(wid, path): the file called just as the item, else the one with _0, else the first by name."""
    name = F.substring_index(F.col(path), "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rank = F.when(stem == F.col(wid), 0).when(stem == F.concat(F.col(wid), F.lit("_0")), 1).otherwise(2)
    return images.groupBy(wid).agg(F.min(F.struct(rank.alias("rank"), name.alias("name"), F.col(path).alias("path"))).alias("best")).select(wid, F.col("best.path").alias(path))


def all_resolved(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """rows as they are, once it is sure that every reference has been resolved: of (reference, result) columns, a result that
    is null is an error that names the reference."""
    for ref, result in pairs:
        unknown = F.raise_error(F.concat(F.lit(f"unknown {ref}: "), F.coalesce(F.col(ref).cast("string"), F.lit("null"))))
        rows = rows.withColumn(result, F.when(F.col(result).isNull(), unknown.cast(rows.schema[result].dataType)).otherwise(F.col(result)))
    return rows
