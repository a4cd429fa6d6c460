"""Readers of exported files: graph shards, manifests, texts, checkpoints, images, batches, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_number, wid_of_stem
from ..operators.catalog import best_path

NODE = "map<string,struct<labels:variant,properties:variant>>"
EDGE = "id long, src long, src_labels array<string>, dst long, dst_labels array<string>, type string"
CHUNK = "chunk_index:long,dir_name:string,node_count:long,edge_count:long,src_node_id_min:long,src_node_id_max:long,nodes_file:string,edges_file:string"
MANIFEST = f"schema_version long, status string, total_nodes long, total_relationships long, last_src_node_id long, completed_nodes long, completed_edges long, chunks array<struct<{CHUNK}>>"
#: Ends of image files' names.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")
TEXT = "wid string, url string, brief string, sections map<string,string>"
RECORD = f"{TEXT}, _fetch_status string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=MANIFEST, multiLine=True)


def chunks(manifest_: DataFrame, first: int | None = None) -> DataFrame:
    """A row for each chunk of a manifest; with `first`, only those chunks, which are the ones read."""
    rows = manifest_.select(F.inline("chunks"))
    return rows if first is None else rows.filter(F.col("chunk_index") < first)


def nodes(spark: SparkSession, paths: str | list[str], list_of_images: str = "image") -> DataFrame:
    """node_id, chunk_id, chunk_pos, wid, labels, images of nodes.json shards: objects by node id. A shard is one task's."""
    shards = spark.read.text(paths, wholetext=True).select(F.from_json("value", NODE).alias("nodes"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"))
    rows = shards.select(chunk_number("folder").cast("int").alias("chunk_id"), F.posexplode("nodes").alias("chunk_pos", "key", "node"))
    # Labels are a list, or one label by itself.
    label = F.col("node.labels")
    labels = F.when(F.schema_of_variant(label) == "STRING", F.array(F.try_variant_get(label, "$", "string"))).otherwise(F.try_variant_get(label, "$", "array<string>"))
    image = F.try_variant_get("node.properties", f"$.{list_of_images}", "variant")
    kind = F.schema_of_variant(image)
    images = F.when(kind == "STRING", F.array(F.try_variant_get(image, "$", "string"))).when(kind.startswith("ARRAY"), F.try_variant_get(image, "$", "array<string>"))
    return rows.select(F.col("key").try_cast("long").alias("node_id"), "chunk_id", "chunk_pos", F.try_variant_get("node.properties", "$.wid", "string").alias("wid"), labels.alias("labels"), images.alias("images"))


def edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, src, dst, type of edges.json shards: arrays of edges."""
    return spark.read.json(paths, schema=EDGE, multiLine=True).select("id", "src", "dst", "type")


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """wid, url, brief, sections and chunk (the file's name) of text shards."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return spark.read.json(paths, schema=TEXT, multiLine=True).select("*", name.alias("chunk"))


def whole_shards(files: DataFrame, record: str) -> DataFrame:
    """(file, position, and the record's columns) of shards that are each one JSON array, read all or nothing: a shard that is
    no array, is cut short or holds anything but objects counts as empty, and the others are read as ever.

    files: whole text files (value, with their metadata). A shard is one task's. Fields that a record lacks, or has in
    another type, are null.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # As the one field of an object, so that nothing may follow the array.
    whole = F.try_parse_json(F.concat(F.lit('{"shard":'), F.ltrim(F.regexp_replace("value", r"^\uFEFF", "")), F.lit("}")))
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    items = F.when(F.size(fields) == 1, F.try_variant_get(whole, "$.shard", "array<variant>"))
    good = F.coalesce(F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False))
    rows = files.select(name.alias("file"), F.when(good, items).alias("items"))
    rows = rows.select("file", F.posexplode("items").alias("position", "item"))
    return rows.select("file", "position", F.from_json(F.to_json("item"), record).alias("record")).select("file", "position", "record.*")


def done_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """wid, url, brief, sections, file, position of text output shards, each read all or nothing, for runs that go on from
    what is there: what a broken shard held is made again."""
    return whole_shards(spark.read.text(paths, wholetext=True), TEXT).filter("wid IS NOT NULL")


def text_places(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """wid, url, brief, sections, chunk and position (the place in its shard) of text shards. A shard is one task's."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    shards = spark.read.text(paths, wholetext=True).select(name.alias("chunk"), F.from_json("value", f"array<struct<{TEXT}>>").alias("texts"))
    return shards.select("chunk", F.posexplode("texts").alias("position", "x")).select("x.*", "chunk", "position")


def node_wids(spark: SparkSession, path: str) -> DataFrame:
    """(wid, pos): the items that a file of nodes names, a list or an object by node id, each at its first place. Another
    structure is an error."""
    node = "struct<properties:struct<wid:variant>>"
    text = F.ltrim("value")
    listed = F.from_json("value", f"array<{node}>")
    keyed = F.map_values(F.from_json("value", f"map<string,{node}>"))
    every = F.when(text.startswith("["), listed).when(text.startswith("{"), keyed).otherwise(F.raise_error(F.lit("nodes are neither a list nor an object")))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(every).alias("pos", "node"))
    wid = F.col("node.properties.wid")
    rows = rows.filter(F.schema_of_variant(wid) == "STRING").select(F.try_variant_get(wid, "$", "string").alias("wid"), "pos")
    return rows.filter(F.col("wid").startswith("Q")).groupBy("wid").agg(F.min("pos").alias("pos"))


def checkpoint_lines(files: DataFrame) -> DataFrame:
    """Records with the file's name and the line they stand in, of whole text files (value, with their metadata). Lines that
    aren't records are skipped. A file is one task's."""
    lines = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    rows = lines.select(F.from_json("text", RECORD).alias("record"), "file", F.col("line").cast("long").alias("line"))
    return rows.select("record.*", "file", "line").filter("wid IS NOT NULL")


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Checkpoint lines; those that aren't records are skipped."""
    return spark.read.json(paths, schema=RECORD, mode="DROPMALFORMED").filter("wid IS NOT NULL")


def done(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(wid) of lists with one a line."""
    return spark.read.text(paths).select(F.trim("value").alias("wid")).filter("wid != ''").distinct()


def images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(wid, path) of image files, by their names; the files' content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem, end = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.filter(end.isin(*extensions)).select(wid_of_stem(stem).alias("wid"), "path").filter("wid IS NOT NULL")


def image_lookup(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(wid, path) of the wanted items' images among files (path): the best of those that lie in the folder itself under
    the item's name, or that with an underscore and more; where there are none, the best of those below it whose
    names begin with the item's. An item without any has a null path."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "end": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))}).filter(F.col("end").isin(*IMAGES))
    items = wanted.select("wid").filter("wid IS NOT NULL").distinct()
    direct = F.regexp_replace("path", "/[^/]*$", "").endswith(folder.rstrip("/").rpartition(":")[2].rstrip("/"))
    here = best_path(rows.filter(direct).select(wid_of_stem(F.col("stem")).alias("wid"), "path").join(items, "wid", "left_semi"))
    rest = items.join(here, "wid", "left_anti")
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem"), F.lit(1))), lambda k: F.substring(F.col("stem"), F.lit(1), k)))
    below = best_path(rows.select(begins.alias("wid"), "path").join(rest, "wid", "left_semi"))
    return items.join(here.unionByName(below), "wid", "left")


def batch(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Inputs to score: a .csv file with a header, or JSON lines."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True).select(*columns)
    return spark.read.json(path, schema=", ".join(f"{c} string" for c in columns))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(node, vector) of a stored cache."""
    return spark.read.parquet(path).select("node", "vector")
