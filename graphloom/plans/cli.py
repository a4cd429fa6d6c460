"""Commands: export a graph, plan its chunks, split and sample its triples, score triples or relations.

python -m graphloom.plans.cli export --tables DIR --output DIR [--overwrite] [--flushes N] [--name NAME]
python -m graphloom.plans.cli plan|split|sample --tables DIR --output DIR [--config FILE] [--overwrite]
python -m graphloom.plans.cli score-triples --vectors DIR --relations DIR (--input FILE | --head X --relation X --tail X) [--output FILE] [--config FILE] [--scorer NAME] [--skip-unknown]
python -m graphloom.plans.cli score-relations --vectors DIR --relations DIR (--input FILE | --head X --tail X) [--output FILE] [--config FILE] [--scorer NAME] [--top-k N] [--skip-unknown]

Settings come from a JSON file (plans/config.py) and, where they are given, from options. Without --output, scores are
printed as JSON lines, at most 1000 of them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, splits, stats
from ..operators import neighbours as N
from ..operators.catalog import all_resolved, resolved_entities, resolved_relations, sent
from ..sources import exports, sharded, tables, writers
from ..sources.store import store_of
from .config import RunConfig
from .graph_queries import Graph


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom")
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export")
    export.add_argument("--tables", required=True)
    export.add_argument("--output", required=True)
    export.add_argument("--overwrite", action="store_true")
    export.add_argument("--flushes", type=int, default=8)
    export.add_argument("--name", default="graph")
    for name in ("plan", "split", "sample"):
        command = commands.add_parser(name)
        for option in ("--tables", "--output"):
            command.add_argument(option, required=True)
        command.add_argument("--config")
        command.add_argument("--overwrite", action="store_true")
    for name in ("score-triples", "score-relations"):
        score = commands.add_parser(name)
        for option in ("--vectors", "--relations"):
            score.add_argument(option, required=True)
        for option in ("--input", "--output", "--config", "--head", "--tail", *(["--relation"] if name == "score-triples" else [])):
            score.add_argument(option)
        score.add_argument("--scorer", choices=sorted(metrics.SCORERS))
        score.add_argument("--skip-unknown", action="store_true")
        if name == "score-relations":
            score.add_argument("--top-k", type=int)
    return parser


def one_item(spark: SparkSession, options: argparse.Namespace, columns: list[str]) -> DataFrame:
    """The batch of a scoring command: its input file, or the one item that its options name."""
    if options.input:
        return exports.batch(spark, options.input, columns)
    values = [getattr(options, c) for c in columns]
    if not all(values):
        raise ValueError(f"give --input, or {', '.join(f'--{c}' for c in columns)}")
    return spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in columns))


def planned(spark: SparkSession, folder: str, config: RunConfig) -> DataFrame:
    """The chunks that an export is to have."""
    return stats.chunk_plan(tables.nodes(spark, folder), config.export.target, config.export.least, config.export.most)


def split(spark: SparkSession, folder: str, config: RunConfig) -> DataFrame:
    """h, r, t, split of all triples."""
    return splits.by_relation(Graph.of(spark, folder).triples, config.split.val, config.split.test, config.split.rare_relation_min_count, config.split.seed)


def sample(spark: SparkSession, folder: str, config: RunConfig) -> DataFrame:
    """batch_id, node, hop of all nodes' neighbourhoods over the train triples, trimmed to the settings' caps."""
    g, s = Graph.of(spark, folder), config.sampler
    train = split(spark, folder, config).filter("split = 'train'")
    nodes = store_of(train, g.catalog, config.split.seed).sample(g.seeds, list(s.fan_out), s.hops, config.split.seed)[0]
    return N.trimmed_images(N.trimmed_in_stages(nodes, s.max_nodes, config.split.seed), g.catalog, s.max_images, config.split.seed)


def score_triples(spark: SparkSession, batch: DataFrame, vectors: DataFrame, relations: DataFrame, scorer: str, skip_unknown: bool = True) -> DataFrame:
    """head, relation, tail, relation_idx, score of a batch of references; an unknown one is an error, or with
    skip_unknown has a null score.

    vectors: node, wid, vector; relations: r, type, vector."""
    names = vectors.select(F.col("node").alias("node_id"), F.col("node").alias("node_idx"), "wid")
    rows = resolved_entities(batch.withColumnRenamed("head", "ref"), names).withColumnsRenamed({"ref": "head", "node_idx": "h"})
    rows = resolved_entities(rows.withColumnRenamed("tail", "ref"), names).withColumnsRenamed({"ref": "tail", "node_idx": "t"})
    rows = resolved_relations(rows, relations.select("type", "r"))
    if not skip_unknown:
        rows = all_resolved(rows, ("head", "h"), ("relation", "r"), ("tail", "t"))
    scored = metrics.scored(rows.filter("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL"), vectors.select("node", "vector"), relations, scorer)
    unknown = rows.filter("h IS NULL OR r IS NULL OR t IS NULL").withColumn("score", F.lit(None).cast("double"))
    return scored.unionByName(unknown).select("head", "relation", "tail", F.col("r").alias("relation_idx"), "score")


def score_relations(spark: SparkSession, batch: DataFrame, vectors: DataFrame, relations: DataFrame, scorer: str, k: int, skip_unknown: bool = True) -> DataFrame:
    """head, tail, top_relations (array of relation, relation_idx, score, best first) of a batch of pairs."""
    names = vectors.select(F.col("node").alias("node_id"), F.col("node").alias("node_idx"), "wid")
    rows = resolved_entities(batch.withColumnRenamed("head", "ref"), names).withColumnsRenamed({"ref": "head", "node_idx": "h"})
    rows = resolved_entities(rows.withColumnRenamed("tail", "ref"), names).withColumnsRenamed({"ref": "tail", "node_idx": "t"})
    if not skip_unknown:
        rows = all_resolved(rows, ("head", "h"), ("tail", "t"))
    pairs = rows.filter("h IS NOT NULL AND t IS NOT NULL").select(F.struct("h", "t").alias("qid"), "h", "t").distinct()
    top = metrics.top_relations(metrics.score_lists(pairs, vectors.select("node", "vector"), relations, scorer), k).join(sent(relations.select("r", "type")), "r")
    row = F.struct("rank", F.col("type").alias("relation"), F.col("r").alias("relation_idx"), "score")
    lists = top.groupBy(F.col("qid.h").alias("h"), F.col("qid.t").alias("t")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x.dropFields("rank")).alias("top_relations"))
    return rows.join(lists, ["h", "t"], "left").select("head", "tail", "top_relations")


def main(arguments: list[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if options.command == "export":
        mode = sharded.export_chunks(tables.nodes(spark, options.tables), tables.edges(spark, options.tables), options.output, options.overwrite, options.flushes, name=options.name)
        print(f"export: {mode}")
        return 0
    config = RunConfig.read(options.config) if options.config else RunConfig()
    if options.command in ("plan", "split", "sample"):
        made = {"plan": planned, "split": split, "sample": sample}[options.command](spark, options.tables, config)
        made.write.mode("overwrite" if options.overwrite else "errorifexists").parquet(options.output)
        return 0
    vectors, relations, scorer = spark.read.parquet(options.vectors), spark.read.parquet(options.relations), options.scorer or config.score.scorer
    if options.command == "score-triples":
        out = score_triples(spark, one_item(spark, options, ["head", "relation", "tail"]), vectors, relations, scorer, options.skip_unknown)
    else:
        out = score_relations(spark, one_item(spark, options, ["head", "tail"]), vectors, relations, scorer, options.top_k or config.score.top_k, options.skip_unknown)
    if options.output:
        writers.scores(out, options.output)
    else:
        print("\n".join(out.toJSON().take(1000)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
