"""The graph store, trims and chunk messages, sharded exports and the ledger stream."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import neighbours as N
from graphloom.sources import exports, sharded, writers
from graphloom.sources.store import GraphStore


def graph(spark, seed: int = 2, n: int = 400):
    """Edges of n nodes, of which node 0 is a hub; ten nodes a chunk."""
    draw = random.Random(seed)
    rows = {(draw.randrange(n), draw.randrange(3), draw.randrange(n)) for _ in range(4 * n)} | {(0, 1, i) for i in range(1, n)}
    return spark.createDataFrame(sorted(rows), "src long, rel int, dst long"), spark.range(n).select(F.col("id").alias("node"), F.floor(F.col("id") / 10).cast("int").alias("chunk_id"))


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_samples_as_the_plain_sampler(spark):
    edges, homes = graph(spark)
    seeds = homes.select((F.col("node") % 5).alias("batch_id"), "node").filter("node % 7 = 0")
    store = GraphStore.create(edges, homes, 3, buckets=4)
    for found, wanted in zip(store.sample(seeds, [4, 2], 3, 3), N.sampled(seeds, edges, [4, 2], 3, 3), strict=True):
        assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    # A batch has no more than 4 edges of the hub at the first hop, whatever its degree.
    hub = store.hop(spark.createDataFrame([(1, 0), (2, 0)], "batch_id long, node long"), 4, 3).groupBy("batch_id").count().collect()
    assert {tuple(r) for r in hub} == {(1, 4), (2, 4)}
    store.drop()
    empty = GraphStore.create(edges.limit(0), homes.limit(0), 3, buckets=2)
    assert empty.sample(seeds, [4], 1, 3)[1].collect() == []


def test_store_is_not_shuffled_and_loads_are_pruned(spark):
    edges, homes = graph(spark)
    store, before = GraphStore.create(edges, homes, 3, buckets=4), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    frontier = N.written(homes.select(F.lit(1).alias("batch_id"), "node"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = plan_of(store.hop(frontier, 3, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 2 and final.count("Bucketed: true") == 2  # the frontier and its draws
    assert final.count("SortMergeJoin") == 2
    for load, group in ((store.of_chunk(7), "(chunk_group#"), (store.of_first(3), "(chunk_group#")):
        text = plan_of(load)
        assert "PartitionFilters: [isnotnull(chunk_group" in text and group in text
    assert store.of_chunk(7).inputFiles() != [] and sorted(map(tuple, store.of_chunk(7).select("src", "rel", "dst").collect())) == sorted(map(tuple, edges.filter("src DIV 10 = 7").collect()))
    assert store.of_first(3).count() == edges.filter("src < 30").count() and store.of_first(0).count() == 0
    read = store.of_first(1)
    read.collect()
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numPartitions").get().value() == 1  # of 40 groups
    store.drop()


def test_trim_in_stages(spark):
    nodes = spark.createDataFrame([(b, i, h) for b in (1, 2) for i, h in enumerate([0, 0, 1, 1, 1, 1, 2, 2, 2, 3])], "batch_id long, node long, hop int")
    for most, of_hops in ((1, [2, 0, 0]), (2, [2, 0, 0]), (4, [2, 2, 0]), (8, [2, 4, 2]), (99, [2, 4, 4])):
        kept = N.trimmed_in_stages(nodes, most, 5)
        rows = kept.collect()
        for b in (1, 2):
            assert [sum(r["batch_id"] == b and min(r["hop"], 2) == h for r in rows) for h in range(3)] == of_hops
        assert {(r["nodes_before"], r["nodes_after"], r["trimmed"]) for r in N.trim_counts(nodes, kept).collect()} == {(10, sum(of_hops), 10 - sum(of_hops))}
    # Both batches hold the same nodes, and a node's place depends on no batch.
    assert {r["node"] for r in N.trimmed_in_stages(nodes, 4, 5).filter("batch_id = 1").collect()} == {r["node"] for r in N.trimmed_in_stages(nodes, 4, 5).filter("batch_id = 2").collect()}


def test_staged_trim_counts(spark):
    """The counts of a trim need no order of the nodes: they equal those of the trim itself, and no node is sorted."""
    nodes = spark.createDataFrame([(b, i, h) for b in (1, 2) for i, h in enumerate([0] * b + [1, 1, 1, 2, 2, 3])] + [(3, 0, 0)], "batch_id long, node long, hop int")
    for most in (0, 1, 2, 4, 7, 99):
        counts = N.staged_trim_counts(nodes, most)
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, N.trim_counts(nodes, N.trimmed_in_stages(nodes, most, 5)).collect()))
    assert "Window" not in plan_of(counts)


def test_image_trim_counts(spark):
    nodes = spark.createDataFrame([(1, i, 0 if i < 3 else 1) for i in range(8)] + [(2, i, 0) for i in range(5)], "batch_id long, node long, hop int")
    catalog = spark.createDataFrame([(i, i % 4 != 3, i % 2 == 0) for i in range(8)], "node_idx long, has_image boolean, is_art boolean")
    for most in (0, 2, 4, 6, 9):
        left = N.trimmed_images(nodes, catalog, most, 1).join(catalog.filter("has_image").select(F.col("node_idx").alias("node")), "node", "left_semi").groupBy("batch_id").count()
        wanted = {r["batch_id"]: r["count"] for r in left.collect()}
        for r in N.image_trim_counts(nodes, catalog, most).collect():
            assert r["images_after"] == wanted[r["batch_id"]] == r["images_before"] - r["trimmed"] and r["cap_exceeded"] == (r["images_after"] > most)


def test_chunk_messages(spark):
    """An edge into another chunk counts in the chunk whose context names its far end, for the node that names it."""
    nodes = spark.createDataFrame([(0, 0), (1, 0), (10, 1), (11, 1)], "node_id long, chunk_id int")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 10), (11, 0), (10, 11), (0, 10)], "src long, dst long")
    context = spark.createDataFrame([(0, 1, 10), (0, 0, 11), (1, 10, 1)], "chunk_id int, node long, other long")
    local = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 10, 2), (0, 11, 3), (1, 10, 0), (1, 11, 1), (1, 1, 2)], "chunk_id int, node long, local int")
    found = sorted(map(tuple, N.chunk_messages(edges, nodes, context, local).collect()))
    assert found == [(0, 0, 1), (0, 1, 2), (0, 3, 0), (1, 0, 1), (1, 2, 0)]  # 0 to 10 is named by neither


def exported(spark, out, **more):
    nodes = spark.createDataFrame([(i, i // 10) for i in range(60)], "node_id long, chunk_id int")
    edges = spark.createDataFrame([(i, i, (i * 7) % 60, "x") for i in range(60) if i // 10 != 4], "id long, src long, dst long, type string")
    return nodes, edges, lambda n=nodes, e=edges, **k: sharded.export_chunks(n, e, out, **({"parts": 3} | more | k))


def test_export_whose_input_has_changed_is_not_gone_on_with(spark, tmp_path):
    out = f"{tmp_path}/out"
    nodes, edges, export = exported(spark, out)
    assert export(stop_after=1) == "fresh"
    for change, told in (
        ({"n": nodes.filter("node_id != 55")}, "total_nodes: 60 planned, 59 now"),
        ({"n": nodes.withColumn("chunk_id", F.when(F.col("node_id") == 9, 9).otherwise(F.col("chunk_id")).cast("int"))}, "chunk_count_planned: 6 planned, 7 now"),
        ({"n": nodes.withColumn("chunk_id", F.when(F.col("node_id") == 9, 1).otherwise(F.col("chunk_id")).cast("int"))}, "nodes_digest"),
        ({"e": edges.filter("id != 3")}, "total_relationships: 50 planned, 49 now"),
        ({"e": edges.withColumn("dst", F.lit(1).cast("long"))}, "edges_digest"),
        ({"name": "other"}, "name: graph planned, other now"),
    ):
        with pytest.raises(sharded.ResumeError, match=told):
            export(**change)
    # Nothing was touched: it goes on over its own input, with a chunk that has no edges.
    assert export() == "resume" and export() == "completed"
    assert spark.read.parquet(f"{out}/nodes").count() == 60 and spark.read.parquet(f"{out}/edges").count() == 50
    assert not (tmp_path / "out" / "placed").exists()
    rows = {r["chunk_index"]: r for r in sharded.done_chunks(spark, out).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and rows[5]["edge_count"] == 0 and (rows[2]["low"], rows[2]["high"]) == (10, 19)


def test_export_that_lost_something_is_not_gone_on_with(spark, tmp_path):
    import shutil

    out = tmp_path / "out"
    nodes, edges, export = exported(spark, str(out))
    export(stop_after=2)
    saved = tmp_path / "saved"
    shutil.copytree(out, saved)

    def faults(hurt) -> str:
        shutil.rmtree(out)
        shutil.copytree(saved, out)
        hurt()
        with pytest.raises(sharded.ResumeError) as told:
            export()
        return str(told.value)

    lines = lambda: [x for f in sorted((out / "manifest").glob("part*")) for x in f.read_text().splitlines()]

    def rewrite(rows: list[str], name: str = "manifest") -> None:
        shutil.rmtree(out / name)
        (out / name).mkdir()
        (out / name / "part-0.json").write_text("\n".join(rows))

    plan = json.loads(next((saved / "plan").glob("part*")).read_text())

    assert "chunk sequence: 1 to 3 planned, 3 up to 4 now" in faults(lambda: rewrite([x for x in lines() if json.loads(x)["chunk_index"] != 2]))
    assert "chunk rows: 2 planned, 1 now; completed_nodes: 20 planned, 10 now" in faults(lambda: rewrite([x for x in lines() if json.loads(x)["chunk_index"] != 4]))
    assert "chunk sequence" in faults(lambda: rewrite([*lines(), lines()[0]]))
    assert "completed_nodes: 20 planned, 21 now" in faults(lambda: rewrite([json.dumps(json.loads(x) | {"node_count": 11}) if json.loads(x)["chunk_index"] == 1 else x for x in lines()]))
    assert "nodes files of 1 chunks: 10 rows planned, 0 rows now" in faults(lambda: shutil.rmtree(out / "nodes" / "chunk_id=1"))
    assert "edges files of 1 chunks: 10 rows planned, 0 rows now" in faults(lambda: shutil.rmtree(out / "edges" / "chunk_id=2"))
    assert "fields: all planned, without edges_digest, name now" in faults(lambda: rewrite([json.dumps({k: v for k, v in plan.items() if k not in ("name", "edges_digest")})], "plan"))
    shutil.rmtree(out)
    shutil.copytree(saved, out)
    shutil.rmtree(out / "placed")  # what can be made again is
    assert export() == "resume" and spark.read.parquet(f"{out}/edges").count() == 50


def test_only_exports_are_overwritten(spark, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "file").write_text("x")
    _, _, export = exported(spark, str(other))
    for overwrite in (False, True):
        with pytest.raises(sharded.ResumeError):
            export(overwrite=overwrite)
    assert (other / "file").exists()
    nodes, edges, export = exported(spark, str(tmp_path / "out"))
    assert export() == "fresh"
    assert export(n=nodes.filter("node_id < 20"), overwrite=True) == "fresh" and spark.read.parquet(f"{tmp_path}/out/nodes").count() == 20
    empty = f"{tmp_path}/empty"
    assert sharded.export_chunks(nodes.limit(0), edges.limit(0), empty) == "fresh" and sharded.export_chunks(nodes.limit(0), edges.limit(0), empty) == "completed"


def test_ledger_keeps_the_last_record_by_file_and_line(spark, tmp_path):
    from graphloom.streaming import ledger as S

    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda wid, status, url: json.dumps({"wid": wid, "url": url, "brief": "", "_fetch_status": status}) + "\n"
    store = spark.conf.get(S._STORE, None)

    def follow(keep: str = "30 days"):
        query = S.follow(S.record_stream(spark, str(folder), 1), f"{tmp_path}/ledger", f"{tmp_path}/state", keep)
        query.awaitTermination()
        return query

    last = lambda: {r["wid"]: (r["_fetch_status"], r["url"], r["file"], r["line"]) for r in S.logged(spark, f"{tmp_path}/ledger").collect()}
    assert S.logged(spark, f"{tmp_path}/ledger") is None
    (folder / "b.jsonl").write_text(line("Q1", "ok", "first") + "broken\n\n" + line("Q2", "error", "") + line("Q1", "ok", "second"))
    follow()
    assert last() == {"Q1": ("ok", "second", "b.jsonl", 4), "Q2": ("error", "", "b.jsonl", 3)}
    # A later file wins, whatever it says; one that comes later but is named before does not. The query starts anew.
    (folder / "a.jsonl").write_text(line("Q2", "ok", "old") + line("Q3", "ok", "c"))
    (folder / "c.jsonl").write_text(line("Q1", "error", "") + line("Q2", "ok", "new"))
    follow()
    assert last() == {"Q1": ("error", "", "c.jsonl", 0), "Q2": ("ok", "new", "c.jsonl", 1), "Q3": ("ok", "c", "a.jsonl", 1)}
    assert {r["wid"] for r in S.known(spark, f"{tmp_path}/ledger").collect()} == {"Q2", "Q3"}
    before = last()
    follow()  # nothing new: nothing changes
    assert last() == before and spark.conf.get(S._STORE, None) == store


def test_ledger_state_is_let_go(spark, tmp_path):
    """Keys that no record has come for are forgotten once the watermark has passed; the ledger still has the right order."""
    from graphloom.streaming import ledger as S

    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, *wids: (folder / name).write_text("".join(json.dumps({"wid": w, "url": name, "_fetch_status": "ok"}) + "\n" for w in wids))

    def follow():
        query = S.follow(S.record_stream(spark, str(folder)), f"{tmp_path}/ledger", f"{tmp_path}/state", "1 second")
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    put("b", *[f"Q{i}" for i in range(50)])
    held = follow()
    time.sleep(2.5)
    put("c", "Q100")
    follow()
    time.sleep(2.5)
    put("a", "Q7")  # named before b, and its key's state is gone
    assert follow() < held / 2
    assert {r["wid"]: r["file"] for r in S.logged(spark, f"{tmp_path}/ledger").collect()}["Q7"] == "b"


def test_shards_are_read_whole_or_not_at_all(spark, tmp_path):
    shards = {
        "a": '[{"wid":"Q1","url":"u","brief":"b","sections":{"x":"y"}},{"wid":"Q2"}]\n', "b": '[{"wid":"Q3"},{"wid":"Q4"', "c": '{"wid":"Q5"}', "d": '[{"wid":"Q6"}, 3]', "e": "", "f": " [] ",
        "g": '[{"wid":"Q7"}] more', "h": '[{"wid":"Q8"}],"x":[1]', "i": '﻿[{"wid":"Q9"}]', "j": "null", "k": "[null]", "l": '[{"wid":null},{"wid":"Q10","other":[1,2]}]',
    }
    for name, text in shards.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = sorted((r["file"], r["position"], r["wid"], r["url"]) for r in exports.done_texts(spark, str(tmp_path)).collect())
    assert found == [("a.json", 0, "Q1", "u"), ("a.json", 1, "Q2", None), ("i.json", 0, "Q9", None), ("l.json", 1, "Q10", None)]


def test_node_array_is_one_list(spark, tmp_path):
    nodes = spark.createDataFrame([(i, None if i % 3 else ["A"]) for i in (5, 1, 9, 3)], "node_id long, labels array<string>")
    writers.node_array(nodes.repartition(3), f"{tmp_path}/some")
    writers.node_array(nodes.limit(0), f"{tmp_path}/none")
    read = lambda name: json.loads("".join(f.read_text() for f in (tmp_path / name).glob("part*")))
    assert read("some") == [{"node_id": i, "labels": None if i % 3 else ["A"]} for i in (1, 3, 5, 9)] and read("none") == []


@pytest.mark.parametrize("page", [3, 1024])
def test_pages_of_adjacency_give_what_the_store_gives(spark, monkeypatch, page):
    monkeypatch.setattr(N, "PAGE", page)
    edges, homes = graph(spark)
    pages, wide = N.adjacency(edges, 3)
    held = pages.select("src", "page", F.posexplode("out").alias("at", "x")).select("src", (F.col("page") * page + F.col("at")).alias("place"), "x.rel", "x.dst")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, N.indexed(edges, 3).select("src", "place", "rel", "dst").collect()))
    assert pages.filter(F.size("out") > page).count() == 0 and (wide.count() > 0) == (page == 3)
    seeds = homes.select((F.col("node") % 5).alias("batch_id"), "node").filter("node % 7 = 0")
    store = GraphStore.create(edges, homes, 3, buckets=4)
    for found, wanted in zip(N.sampled(seeds, edges, [4, 2], 3, 3), store.sample(seeds, [4, 2], 3, 3), strict=True):
        assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    store.drop()


def test_contexts_tell_pairs_apart_before_they_are_turned(spark):
    """Doubled, turned and looped edges give each neighbour once; no aggregate runs over rows of both directions."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 1), (1, 3), (4, 1), (None, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1, 0, False), (2, 1, False), (3, 0, True), (4, 2, True)], "node_id long, chunk_id long, is_art boolean")
    found = N.cross_context(edges, nodes, 5, 1)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 2), (0, 1, 4), (1, 2, 1), (2, 4, 1)]
    assert sorted(map(tuple, N.cross_context(edges, nodes, 1, 1).collect())) == [(0, 1, 4), (1, 2, 1), (2, 4, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Union") < plan.index("Aggregate")


def test_chunk_messages_make_their_context_once(spark, small, monkeypatch):
    from graphloom.plans import train_queries

    made, whole = [], N.cross_context
    monkeypatch.setattr(N, "cross_context", lambda *given: made.append(1) or whole(*given))
    train_queries.chunk_messages(spark, small)
    assert len(made) == 1


def test_samples_lie_by_batch(spark):
    """What follows a sample by batch shuffles none of its rows again; both ends of links come from one reading."""
    edges, homes = graph(spark)
    seeds = homes.select((F.col("node") % 5).alias("batch_id"), "node").filter("node % 7 = 0")
    nodes, picked = N.sampled(seeds, edges, [4, 2], 2, 3)
    catalog = homes.select(F.col("node").alias("node_idx"), (F.col("node") % 2 == 0).alias("has_image"), (F.col("node") % 4 == 0).alias("is_art"))
    for found in (N.trimmed(nodes, 9), N.trimmed_in_stages(nodes, 9, 1), N.trimmed_images(nodes, catalog, 3, 1), N.image_trim_counts(nodes, catalog, 3)):
        assert "hashpartitioning(" not in plan_of(found)
    assert "hashpartitioning(node" not in plan_of(N.induced(nodes, picked)[1])
    links = N.links(edges.select(F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t")))
    assert N.both_ways(links)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_prepared_batches_against_brute_force(spark):
    edges, homes = graph(spark)
    catalog = homes.select(F.col("node").alias("node_idx"), (F.col("node") % 2 == 0).alias("has_image"), (F.col("node") % 4 == 0).alias("is_art"))
    mine = edges.filter("src % 9 = 0 AND src != dst").select(((F.col("src") / 9).cast("long") % 3).alias("batch_id"), F.col("src").alias("h"), F.col("dst").alias("t"))
    seeds = mine.selectExpr("batch_id", "explode(array(h, t)) AS node")
    nodes, picked = N.sampled(seeds, edges, [5], 1, 2)
    every = sorted(map(tuple, nodes.select("batch_id", "hop", "node").collect()))
    drawn = [tuple(r) for r in picked.select("batch_id", "src", "rel", "dst").collect()]
    hidden = {(b, *sorted((h, t))) for b, h, t in map(tuple, mine.collect())}
    for most in (10_000, max(sum(r[0] == b and r[1] == 0 for r in every) for b in range(3)) + 4):
        got = N.prepared(seeds, mine, edges, catalog, [5], 1, most, 6, 2)
        kept = {tuple(r) for r in N.trimmed_images(N.trimmed(nodes, most), catalog, 6, 2).select("batch_id", "hop", "node").collect()}
        local = {(b, n): i for b in range(3) for i, (_, n) in enumerate(sorted(r[1:] for r in kept if r[0] == b))}
        assert {(r["batch_id"], r["node"]): r["local"] for r in got["nodes"].collect()} == local
        inner = [(b, s, r, d, local[b, s], local[b, d]) for b, s, r, d in drawn if (b, s) in local and (b, d) in local and (b, *sorted((s, d))) not in hidden]
        assert inner and sorted(tuple(r) for r in got["edges"].select("batch_id", "src", "rel", "dst", "src_local", "dst_local").collect()) == sorted(inner)
        for r in got["counts"].collect():
            own = [n for b, _, n in kept if b == r["batch_id"]]
            assert (r["nodes"], r["edges"]) == (len(own), sum(e[0] == r["batch_id"] for e in inner))
            assert (r["images"], r["trimmed"]) == (sum(n % 2 == 0 for n in own), sum(e[0] == r["batch_id"] for e in every) - len(own))
        assert got["counts"].count() == 3


def test_store_ranks_no_edges_but_those_of_hubs(spark, monkeypatch):
    """Hubs and others get the numbers of `indexed` and their degrees; only hubs are ranked by windows."""
    monkeypatch.setattr(N, "PAGE", 50)
    edges, homes = graph(spark)
    edges = edges.unionByName(spark.createDataFrame([(5000, 1, 2)], edges.schema))  # its source has no chunk
    wanted = N.indexed(edges, 3).join(homes.withColumnRenamed("node", "src"), "src").select("src", "place", "rel", "dst", "chunk_id")
    wanted = sorted(map(tuple, wanted.collect()))
    ranked = []
    monkeypatch.setattr(N, "indexed", lambda rows, seed, whole=N.indexed: ranked.append(rows.select("src").distinct().count()) or whole(rows, seed))
    store = GraphStore.create(edges, homes, 3, buckets=4)
    assert ranked == [1]
    assert sorted(map(tuple, store.edges.collect())) == wanted
    assert sorted(map(tuple, store.degrees.collect())) == sorted({(r[0], sum(x[0] == r[0] for x in wanted)) for r in wanted})
    store.drop()
