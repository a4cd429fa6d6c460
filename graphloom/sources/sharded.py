"""Exports by chunk that can be stopped and gone on with. What is there is bound to the input it was made of.

A folder holds `plan` (one row: what the input was, and how it is cut), `placed` (nodes and edges dealt by part, made once,
dropped at the end), `nodes` and `edges` (by chunk_id), and `manifest` (a row for each chunk that is done). A run goes on
only if the input is still that of the plan and the manifest, its sums and the files agree; otherwise every
disagreement is named in the error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered

FORMAT = 2
PLAN = "format long, name string, total_nodes long, total_relationships long, chunk_count_planned long, parts long, nodes_digest long, edges_digest long"
#: A chunk's row also says what the part it was written with held, so that a lost row or file of rows shows.
MANIFEST = "chunk_index long, chunk_id int, node_count long, edge_count long, low long, high long, part long, part_chunks long, part_nodes long, part_edges long"
OURS = {"plan", "placed", "nodes", "edges", "manifest"}
FAULT = "fault string, planned string, found string"


class ResumeError(ValueError):
    """An export can't be gone on with."""


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    files, path = _path(spark, folder)
    return files.exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.delete(path, True)


def snapshot(nodes: DataFrame, edges: DataFrame, name: str) -> dict:
    """What an export is bound to: counts and digests of its input, in one pass over each table."""
    n = nodes.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("node_id", "chunk_id")), F.lit(0)).alias("digest")).first()
    e = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id", "src", "dst", "type")), F.lit(0)).alias("digest")).first()
    return {"format": FORMAT, "name": name, "total_nodes": n["n"], "total_relationships": e["n"], "chunk_count_planned": nodes.select("chunk_id").distinct().count(), "nodes_digest": n["digest"], "edges_digest": e["digest"]}


def plan_of(spark: SparkSession, folder: str) -> dict | None:
    """The plan an export began with; None if there is none, nulls for fields that it lacks."""
    if not _exists(spark, f"{folder}/plan"):
        return None
    row = spark.read.schema(PLAN).json(f"{folder}/plan").first()
    return row.asDict() if row else None


def done_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest rows of the chunks that are done."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def export_mode(spark: SparkSession, folder: str, overwrite: bool = False) -> str:
    """What an export into the folder would be: fresh, resume or completed. A folder that holds anything that no export has
    made is an error, with overwrite, too."""
    files, path = _path(spark, folder)
    there = {f.getPath().getName() for f in files.listStatus(path)} if files.exists(path) else set()
    if there - OURS or there and "plan" not in there:
        raise ResumeError(f"{folder} is not empty and has no plan of an export")
    plan = plan_of(spark, folder)
    if not there or overwrite or plan is None:
        return "fresh"
    return "completed" if done_chunks(spark, folder).count() == plan["chunk_count_planned"] else "resume"


def _counted(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(chunk_id, rows) of what is written; Spark reads no more than the files' footers."""
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], "chunk_id int, rows long")
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.groupBy(F.col("chunk_id").cast("int").alias("chunk_id")).agg(F.count("*").alias("rows")) if "chunk_id" in rows.columns else spark.createDataFrame([], "chunk_id int, rows long")


def resume_faults(spark: SparkSession, folder: str, now: dict) -> list[tuple[str, str, str]]:
    """(fault, planned, found) of everything in which an export disagrees with itself or with its input (a snapshot of it),
    in a fixed order; empty if a run may go on."""
    plan = plan_of(spark, folder)
    if plan is None:
        return [("plan", "one", "none")]
    faults = [("fields", "all", f"without {', '.join(missing)}")] if (missing := sorted(k for k, v in plan.items() if v is None)) else []
    faults += [(k, str(plan[k]), str(now[k])) for k in now if plan[k] is not None and plan[k] != now[k]]

    done = done_chunks(spark, folder)
    sums = done.agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("different"), F.max("chunk_index").alias("last"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges")).first()
    if sums["n"] and not (sums["n"] == sums["different"] == sums["last"]):
        faults.append(("chunk sequence", f"1 to {sums['n']}", f"{sums['different']} up to {sums['last']}"))
    of_part = done.groupBy("part").agg(F.count("*").alias("chunks"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"), F.max("part_chunks").alias("c"), F.max("part_nodes").alias("n"), F.max("part_edges").alias("e"))
    for name, own, said in (("chunk rows", "chunks", "c"), ("completed_nodes", "nodes", "n"), ("completed_edges", "edges", "e")):
        bad = of_part.filter(~F.col(own).eqNullSafe(F.col(said))).agg(F.sum(said), F.sum(own)).first()
        if bad[0] is not None or bad[1] is not None:
            faults.append((name, str(bad[0]), str(bad[1])))
    if sums["n"] == plan["chunk_count_planned"] and (sums["nodes"] or 0, sums["edges"] or 0) != (plan["total_nodes"], plan["total_relationships"]):
        faults.append(("totals of all chunks", f"{plan['total_nodes']} and {plan['total_relationships']}", f"{sums['nodes']} and {sums['edges']}"))
    for name, count in (("nodes", "node_count"), ("edges", "edge_count")):
        found = done.select("chunk_id", F.col(count).alias("said")).join(_counted(spark, folder, name), "chunk_id", "left")
        bad = found.filter(F.coalesce("rows", F.lit(0)) != F.col("said")).agg(F.count("*"), F.sum("said"), F.sum(F.coalesce("rows", F.lit(0)))).first()
        if bad[0]:
            faults.append((f"{name} files of {bad[0]} chunks", f"{bad[1]} rows", f"{bad[2]} rows"))
    return faults


def _placed(nodes: DataFrame, edges: DataFrame, folder: str, plan: dict) -> None:
    """Nodes and edges with chunk_index and part, written once: an edge goes with its source. Chunks follow one another in
    parts, so what is done is always a beginning of the plan."""
    spark = nodes.sparkSession
    chunks = numbered(nodes.select("chunk_id").distinct(), "place", F.floor(F.col("chunk_id") / 1024), [F.col("chunk_id")])
    part = F.floor(F.col("place") * plan["parts"] / F.lit(max(1, plan["chunk_count_planned"]))).cast("int")
    chunks = chunks.select("chunk_id", (F.col("place") + 1).alias("chunk_index"), part.alias("part"))
    nodes.join(chunks, "chunk_id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/placed/nodes")
    owners = spark.read.parquet(f"{folder}/placed/nodes").select(F.col("node_id").alias("src"), "chunk_id", "chunk_index", "part")
    edges.join(owners, "src").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/placed/edges")


def export_chunks(nodes: DataFrame, edges: DataFrame, folder: str, overwrite: bool = False, parts: int = 8, stop_after: int | None = None, name: str = "graph") -> str:
    """Write nodes and edges by chunk in `parts` parts and add each part's chunks to the manifest once they are written.

    Run again after a stop, it checks that nothing has changed and writes the chunks that the manifest lacks, over what was
    left of them; ResumeError names all that has changed. Returns the mode it began in; stop_after ends it after so many
    parts. With overwrite, what an export has left in the folder goes first.
    """
    spark = nodes.sparkSession
    mode, now = export_mode(spark, folder, overwrite), snapshot(nodes, edges, name)
    if mode == "fresh":
        delete_folder(spark, folder)
        plan = now | {"parts": parts}
        columns = [c.split()[0] for c in PLAN.split(", ")]
        spark.createDataFrame([tuple(plan[c] for c in columns)], PLAN).coalesce(1).write.json(f"{folder}/plan")
    else:
        if faults := resume_faults(spark, folder, now):
            raise ResumeError(f"{folder} can't be gone on with: " + "; ".join(f"{f}: {p} planned, {x} now" for f, p, x in faults))
        plan = plan_of(spark, folder)
    if mode == "completed" or not plan["chunk_count_planned"]:
        return mode
    if not _exists(spark, f"{folder}/placed/edges/_SUCCESS"):
        _placed(nodes, edges, folder, plan)
    done = {r["part"] for r in done_chunks(spark, folder).select("part").distinct().collect()}  # at most `parts` numbers
    todo = [k for k in range(plan["parts"]) if k not in done and _exists(spark, f"{folder}/placed/nodes/part={k}")]
    for k in todo[:stop_after]:
        own = {t: spark.read.option("basePath", f"{folder}/placed/{t}").parquet(f"{folder}/placed/{t}/part={k}") for t in ("nodes", "edges") if _exists(spark, f"{folder}/placed/{t}/part={k}")}
        for t, order in (("nodes", ["node_id"]), ("edges", ["src", "id"])):
            if t in own:
                # Of the chunks at hand whatever a stopped run has left is replaced; others stay.
                rows = own[t].drop("part", "chunk_index").repartition("chunk_id").sortWithinPartitions("chunk_id", *order)
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(f"{folder}/{t}")
        rows = own["nodes"].groupBy("chunk_index", "chunk_id").agg(F.count("*").alias("node_count"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))
        links = own["edges"].groupBy("chunk_id").agg(F.count("*").alias("edge_count")) if "edges" in own else spark.createDataFrame([], "chunk_id int, edge_count long")
        rows = rows.join(links, "chunk_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
        sums = rows.agg(F.lit(k).alias("part"), F.count("*").alias("part_chunks"), F.sum("node_count").alias("part_nodes"), F.sum("edge_count").alias("part_edges"))
        rows.crossJoin(sums).coalesce(1).write.mode("append").json(f"{folder}/manifest")  # one row of sums
    if len(todo) == len(todo[:stop_after]):
        delete_folder(spark, f"{folder}/placed")
    return mode
