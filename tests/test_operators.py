from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.hashing import draw, order_hash
from graphloom.operators import catalog as C
from graphloom.operators import ledger, metrics, negatives, order, splits, stats
from graphloom.operators import neighbours as N
from graphloom.plans.config import RunConfig
from graphloom.sources import exports, sharded, writers


def triples(spark, n=3000, nodes=200, relations=4, seed=1):
    rng = random.Random(seed)
    rows = {(rng.randrange(nodes), min(int(rng.expovariate(1)), relations - 1), rng.randrange(nodes)) for _ in range(n)}
    return spark.createDataFrame(sorted(rows), "h long, r int, t long")


def test_first_and_last_wins(spark):
    nodes = spark.createDataFrame([(10, 0, 0, "Q1", ["ART"], None), (7, 0, 1, "Q1", ["X"], ["http://a"]), (9, 1, 0, None, None, []), (10, 1, 1, "Q2", [], [])], "node_id long, chunk_id int, chunk_pos int, wid string, labels array<string>, images array<string>")
    catalog = C.entities(nodes)
    assert [tuple(r)[:5] for r in catalog.orderBy("node_idx").collect()] == [(0, 10, "Q1", False, True), (1, 7, "Q1", True, False), (2, 9, "", False, False), (3, 10, "Q2", False, False)]
    assert {tuple(r) for r in C.first_by_wid(catalog).collect()} == {("Q1", 0), ("Q2", 3)}
    edges = spark.createDataFrame([(1, 10, 7, " A "), (2, 7, 10, " "), (3, 10, 999, "B"), (4, 10, 7, "A"), (5, 9, 9, "C"), (6, 7, 10, None)], "id long, src long, dst long, type string")
    assert sorted(map(tuple, C.triples(edges, catalog).collect())) == [(2, 1, 2, 5), (3, 0, 1, 1)]
    refs = spark.createDataFrame([("Q1",), ("10",), ("Q9",), (None,)], "ref string")
    assert {tuple(r) for r in C.resolved_entities(refs, catalog).collect()} == {("Q1", 0), ("10", 3), ("Q9", None), (None, None)}


def test_numbers_and_ranks(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("k"))
    got = order.numbered(rows, "n", F.floor(F.col("id") / 7).cast("long"), [F.col("id")]).collect()
    assert all(r["n"] == r["id"] for r in got)
    from graphloom.functions.hashing import order_hash

    ranked = order.ranked_within(rows, ["k"], "n", order_hash(1, "id"), [F.col("id")]).collect()
    for k in range(3):
        own = [r["n"] for r in ranked if r["k"] == k]
        assert sorted(own) == list(range(len(own)))


def test_split_rules(spark):
    rows = triples(spark)
    split = splits.by_relation(rows, 0.1, 0.1, 30, 3)
    counts = {}
    for r in split.groupBy("r", "split").count().collect():
        counts.setdefault(r["r"], {})[r["split"]] = r["count"]
    for own in counts.values():
        size = sum(own.values())
        part = 0 if size <= 30 else max(1, int(size * 0.1))
        assert (own.get("val", 0), own.get("test", 0)) == (part, part)
    assert split.drop("split").exceptAll(rows).count() == 0 and split.count() == rows.count()
    fixed = splits.repaired(split)
    train = fixed.filter("split = 'train'")
    seen = {r[0] for r in train.select("h").unionAll(train.select("t")).collect()}
    assert all(r["h"] in seen and r["t"] in seen for r in fixed.filter("split != 'train'").collect())
    assert sorted(map(tuple, splits.by_relation(rows.repartition(7), 0.1, 0.1, 30, 3).collect())) == sorted(map(tuple, split.collect()))


def test_split_shuffles_few_rows(spark):
    """Rows are shuffled only where a relation's split changes, and the split is that of a rank over all rows."""
    from graphloom.functions.hashing import order_hash

    rows = spark.range(20000).select(F.col("id").alias("h"), F.when(F.col("id") < 15, 2).otherwise(F.col("id") % 2).cast("int").alias("r"), (F.col("id") % 777).alias("t"))
    split = splits.by_relation(rows, 0.1, 0.1, 30, 3)
    assert split._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    ranked = order.ranked_within(rows, ["r"], "n", order_hash(3, "h", "r", "t"), [F.col("h"), F.col("t")])
    size = dict(map(tuple, rows.groupBy("r").count().collect()))
    part = {r: 0 if n <= 30 else int(n * 0.1) for r, n in size.items()}
    want = {(x["h"], x["r"], x["t"], "test" if x["n"] < part[x["r"]] else "val" if x["n"] < 2 * part[x["r"]] else "train") for x in ranked.collect()}
    assert set(map(tuple, split.collect())) == want and split.count() == 20000


def test_pair_split(spark):
    edges = triples(spark).select(F.col("h").alias("src"), F.col("t").alias("dst"))
    split = splits.of_pairs(edges, 0.8, 0.1, 1)
    n = split.count()
    counts = dict(map(tuple, split.groupBy("split").count().collect()))
    assert counts == {"train": int(n * 0.8), "val": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    assert [r["n"] for r in splits.overlaps(split, ["lo", "hi"]).collect()] == [0, 0, 0]
    assert sum(r["n"] for r in splits.overlaps(split.unionAll(split.withColumn("split", F.lit("test"))), ["lo", "hi"]).collect()) == counts["train"] + counts["val"]
    with pytest.raises(ValueError):
        splits.of_pairs(edges, 0.9, 0.2, 1)


def test_negatives(spark):
    rows = triples(spark)
    known = {tuple(r) for r in rows.collect()}
    got = negatives.of_triples(rows, rows, 200, 1).collect()
    assert len(got) == len(known)
    for r in got:
        assert r["valid"] and r["neg_h"] != r["neg_t"] and (r["neg_h"], r["r"], r["neg_t"]) not in known
        assert (r["neg_h"] == r["h"]) != (r["neg_t"] == r["t"]) or (r["neg_h"], r["neg_t"]) != (r["h"], r["t"])
    pairs = N.undirected(rows.select(F.col("h").alias("src"), F.col("t").alias("dst")))
    lows = {tuple(r) for r in pairs.collect()}
    pool = spark.range(200).select(F.col("id").alias("place"), F.col("id").alias("node"))
    for r in negatives.of_pairs(pairs, pairs, pool, 1).collect():
        assert r["valid"] and tuple(sorted((r["lo"], r["neg"]))) not in lows and r["neg"] != r["lo"]
    # All of a pool are known: no row has a negative, and none is lost.
    full = spark.createDataFrame([(0, k) for k in range(5)], "lo long, hi long")
    small = pool.filter("place < 5")
    assert [r["valid"] for r in negatives.of_pairs(full, full, small, 1).collect()] == [False] * 5
    assert [r["valid"] for r in negatives.of_pairs(full, full, pool.limit(0), 1).collect()] == [False] * 5


def test_search_and_samples(spark):
    edges = triples(spark, 400, 150).select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"))
    links = {}
    for r in edges.collect():
        links.setdefault(r["src"], set()).add(r["dst"])
        links.setdefault(r["dst"], set()).add(r["src"])
    want, front = {0: 0, 5: 0}, {0, 5}
    for hop in (1, 2, 3):
        front = {y for x in front for y in links.get(x, ())} - set(want)
        want |= dict.fromkeys(front, hop)
    seeds = spark.createDataFrame([(0,), (5,)], "node long")
    assert dict(map(tuple, N.breadth_first(seeds, edges, 3).collect())) == want
    batches = spark.createDataFrame([(b, n) for b in range(3) for n in range(b * 10, b * 10 + 10)], "batch_id long, node long")
    prop = N.both_ways(edges).distinct()
    nodes, picked = N.sampled(batches, prop, [4, 2], 2, 1)
    there, degree = {tuple(r) for r in prop.select("src", "rel", "dst").collect()}, {}
    for s, _, _ in there:
        degree[s] = degree.get(s, 0) + 1
    taken = {}
    for r in picked.collect():
        assert (r["src"], r["rel"], r["dst"]) in there
        taken.setdefault((r["batch_id"], r["hop"], r["src"]), set()).add((r["rel"], r["dst"]))
    assert all(len(x) == min((4, 2)[hop - 1], degree[s]) for (_, hop, s), x in taken.items())
    assert nodes.count() == nodes.select("batch_id", "node").distinct().count()
    cut = N.trimmed(nodes, 15)
    assert max(r["count"] for r in cut.groupBy("batch_id").count().collect()) <= 15 and cut.filter("hop = 0").count() == 30
    local, inner = N.induced(cut, picked)
    assert local.groupBy("batch_id").agg((F.max("local") + 1 == F.count("*")).alias("x")).filter("NOT x").count() == 0
    pairs = inner.select("batch_id", F.col("dst").alias("h"), F.col("src").alias("t")).limit(5)
    left = N.masked(picked, pairs)
    hidden = {(r["batch_id"], frozenset((r["h"], r["t"]))) for r in pairs.collect()}
    assert not [r for r in left.collect() if (r["batch_id"], frozenset((r["src"], r["dst"]))) in hidden] and left.count() < picked.count()


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(30) / 10, rng.randrange(2)) for g in range(3) for _ in range(300)] + [(9, 1.0, 1)]
    got = {r["g"]: r for r in metrics.auc_ap(spark.createDataFrame(rows, "g int, score double, label int"), "g").collect()}
    for g in range(3):
        pos, neg = ([s for k, s, y in rows if k == g and y == c] for c in (1, 0))
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        ap = sum(sum(p == s for p in pos) * sum(p >= s for p in pos) / (sum(p >= s for p in pos) + sum(q >= s for q in neg)) for s in set(pos)) / len(pos)
        assert got[g]["auc"] == pytest.approx(auc) and got[g]["ap"] == pytest.approx(ap)
    assert (got[9]["auc"], got[9]["ap"]) == (0.5, 0.0)


def test_ranks(spark):
    lists = [[{"r": r, "score": s} for r, s in ((0, 3.0), (1, 2.0), (2, 2.0), (3, 1.0))]]
    scored = spark.createDataFrame([(1, 0, 1, 1, *lists), (2, 0, 2, 3, *lists), (3, 0, 3, 9, *lists)], "qid int, h int, t int, r int, scores array<struct<r:int,score:double>>")
    known = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "h int, r int, t int")
    # The better one is true, too; without that it counts. A target that has no score is left out.
    assert sorted(map(tuple, metrics.filtered_ranks(scored, known).collect())) == [(1, 1, 1, 1), (2, 3, 4, 0)]
    assert sorted(map(tuple, metrics.filtered_ranks(scored, known.limit(0)).collect())) == [(1, 1, 2, 0), (2, 3, 4, 0)]
    assert sorted(map(tuple, metrics.top_relations(scored.filter("qid = 1"), 3).collect())) == [(1, 0, 1, 3.0), (1, 1, 2, 2.0), (1, 2, 3, 2.0)]
    plan = metrics.filtered_ranks(scored, known)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    scores = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 1, 0, 2.0), ("a", 2, 1, 3.0), ("a", 2, 0, 2.0)], "g string, qid int, label int, score double")
    assert tuple(metrics.hit_at(scores, 1, "g").first()) == ("a", 2, 0.5)  # a tie counts against the positive


def test_score_lists_in_parts(spark):
    """However many parts the list of relations is sent in, a pair's list is the same."""
    entities = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "node int, vector array<double>")
    relations = spark.createDataFrame([(r, [0.5 * r, -1.0]) for r in range(7)], "r int, vector array<double>")
    queries = spark.createDataFrame([(10, 0, 1), (11, 2, 3)], "qid int, h int, t int")
    whole, parts = (sorted(map(tuple, metrics.score_lists(queries, entities, relations, "transe", most).collect())) for most in (1 << 20, 40))
    assert whole == parts and [x["r"] for x in whole[0][3]] == list(range(7))
    assert whole[0][3][2]["score"] == pytest.approx(-(((0 + 1 - 1) ** 2 + (1 - 1 - 1) ** 2) ** 0.5))


def test_empty_subsets_have_rows(spark):
    rows = metrics.auc_ap(spark.createDataFrame([("global", 1.0, 1), ("global", 0.0, 0)], "subset string, score double, label int"), "subset")
    found = {tuple(r) for r in metrics.for_all_subsets(rows, n_pos=0, n_neg=0, auc=0.0, ap=0.0).collect()}
    assert found == {("global", 1, 1, 1.0, 1.0), ("art_art", 0, 0, 0.0, 0.0), ("art_any", 0, 0, 0.0, 0.0)}


def test_vector_sums_shuffle_a_row_a_node(spark):
    """Means of vectors of 300 places, with a hub: no row for each place, and no null vector counts."""
    from graphloom.operators import messages

    draw = random.Random(3)
    vectors = {i: [draw.random() for _ in range(300)] for i in range(20)}
    rows = spark.createDataFrame([*vectors.items(), (20, None)], "node int, vector array<double>")
    edges = spark.createDataFrame([(i, 99) for i in range(21)] + [(0, 5), (1, 5)], "src int, dst int")
    frame = messages.mean_aggregate(edges, rows)
    found = {r["node"]: r["vector"] for r in frame.collect()}
    assert found[99] == pytest.approx([sum(v[k] for v in vectors.values()) / 20 for k in range(300)])
    assert found[5] == pytest.approx([(vectors[0][k] + vectors[1][k]) / 2 for k in range(300)])
    assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
    blended = {r["node"]: r["vector"] for r in messages.encoder("Blend")(edges, rows.filter("vector IS NOT NULL")).collect()}
    assert blended[3] == vectors[3] and blended[5] == pytest.approx([(vectors[5][k] + found[5][k]) / 2 for k in range(300)])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rolling_in_parts(spark, parts):
    """Windows reach over parts with fewer rows than their width, whatever the parts are; values may be null."""
    draw = random.Random(parts)
    rows = [(s, step, None if draw.random() < 0.1 else draw.random()) for s in "ab" for step in draw.sample(range(500), 60 if s == "a" else 7)]
    frame = spark.createDataFrame(rows, "series string, step long, value double")
    for width in (1, 2, 20):
        found = {(r["series"], r["step"]): r for r in stats.rolling(frame, "series", "step", "value", width, parts).collect()}
        assert len(found) == len(rows)
        for s in "ab":
            line = sorted((step, v) for k, step, v in rows if k == s)
            for i, (step, _) in enumerate(line):
                own = [v for _, v in line[max(0, i + 1 - width) : i + 1] if v is not None]
                mean = sum(own) / len(own) if own else None
                assert found[(s, step)]["mean"] == (pytest.approx(mean) if own else None)
                assert found[(s, step)]["var"] == (pytest.approx(sum((v - mean) ** 2 for v in own) / len(own), abs=1e-12) if own else None)
    assert stats.rolling(frame.limit(0), "series", "step", "value", 5, parts).collect() == []


def test_permutations(spark):
    """Every key's permutation has each place once; keys differ; no two slots of a batch meet, unless rows are too few."""
    for n in (1, 2, 3, 7, 50, 1000):
        sent = [r[0] for r in spark.range(n).select(order.permuted("id", n, "x", F.lit(1))).collect()]
        assert sorted(sent) == list(range(n))
    other = [r[0] for r in spark.range(1000).select(order.permuted("id", 1000, "x", F.lit(2))).collect()]
    assert sent != other and sum(a == b for a, b in zip(sent, other)) < 20
    placed = spark.range(300).select(F.col("id").alias("place"), (F.col("id") * 10).alias("x"))
    rows = splits.drawn_batches(placed, 300, 6, 128, 5).collect()
    batches = {b: [r["x"] for r in rows if r["batch_id"] == b] for b in range(6)}
    assert all(len(x) == len(set(x)) == 128 for x in batches.values()) and batches[0] != batches[1]
    few = splits.drawn_batches(placed.filter("place < 5"), 5, 3, 8, 5).collect()
    assert len(few) == 24 and {r["x"] for r in few} <= {0, 10, 20, 30, 40}
    assert splits.drawn_batches(placed.limit(0), 0, 3, 8, 5).collect() == []


def test_chunk_sizes():
    for total in (0, 1, 9_999, 10_000, 25_000, 30_001, 50_000, 123_456):
        sizes = stats.chunk_sizes(total)
        assert sum(sizes) == total and (not sizes or max(sizes) - min(sizes) <= 1 and max(sizes) <= 30_000)
    assert stats.chunk_sizes(50_000) == [25_000, 25_000]  # round half to even


def test_exports(spark, tmp_path):
    folder = tmp_path / "chunks" / "chunk_000000_nid_0000000007_0000000010"
    folder.mkdir(parents=True)
    (folder / "nodes.json").write_text(json.dumps({"10": {"labels": ["ART"], "properties": {"wid": "Q1", "image": "http://a/x.jpg"}}, "7": {"labels": ["PERSON", " ART"], "properties": {"wid": "Q2", "image": ["HTTPS://b/y.png", "ftp://c"]}}, "9": {"labels": [], "properties": {"wid": None}}}))
    (folder / "edges.json").write_text(json.dumps([{"id": 1, "src": 10, "src_labels": ["ART"], "dst": 7, "dst_labels": ["PERSON"], "type": "MADE"}]))
    nodes = exports.nodes(spark, f"{tmp_path}/chunks/*/nodes.json")
    assert [tuple(r) for r in nodes.orderBy("chunk_pos").collect()] == [(10, 0, 0, "Q1", ["ART"], ["http://a/x.jpg"]), (7, 0, 1, "Q2", ["PERSON", " ART"], ["HTTPS://b/y.png", "ftp://c"]), (9, 0, 2, None, [], None)]
    edges = exports.edges(spark, f"{tmp_path}/chunks/*/edges.json")
    assert [tuple(r) for r in edges.collect()] == [(1, 10, 7, "MADE")]
    rows = writers.graph_export(nodes, edges, f"{tmp_path}/out")
    assert [tuple(r) for r in rows.collect()] == [(0, 3, 1, 7, 10)]
    assert spark.read.parquet(f"{tmp_path}/out/nodes").count() == 3
    (tmp_path / "records.jsonl").write_text('{"wid":"Q1","url":"","brief":"a","_fetch_status":"error"}\nnot json\n{"wid":"Q1","url":"u","brief":"b","_fetch_status":"ok"}\n')
    assert exports.records(spark, f"{tmp_path}/records.jsonl").count() == 2
    for name in ("Q5_3.jpg", "Q5_0.png", "Q6.webp", "x.jpg", "Q7.txt"):
        (tmp_path / "images").mkdir(exist_ok=True)
        (tmp_path / "images" / name).write_bytes(b"x")
    best = C.best_path(exports.images(spark, f"{tmp_path}/images"))
    assert {(r["wid"], r["path"].rpartition("/")[2]) for r in best.collect()} == {("Q5", "Q5_0.png"), ("Q6", "Q6.webp")}
    writers.scores(rows.withColumn("top", F.array(F.lit(1))), f"{tmp_path}/scores.csv")
    assert spark.read.csv(f"{tmp_path}/scores.csv", header=True).first()["top_json"] == "[1]"
    batch = tmp_path / "in.csv"
    batch.write_text("head,relation,tail\nQ1,MADE,7\n")
    assert tuple(exports.batch(spark, str(batch), ["head", "relation", "tail"]).first()) == ("Q1", "MADE", "7")


def test_scoring_commands(spark):
    from graphloom.plans import cli

    vectors = spark.createDataFrame([(1, "Q1", [1.0, 0.0]), (2, "Q2", [0.0, 1.0])], "node long, wid string, vector array<double>")
    relations = spark.createDataFrame([(0, "A", [-1.0, 1.0]), (1, "B", [0.0, 0.0])], "r int, type string, vector array<double>")
    batch = spark.createDataFrame([("Q1", "A", "2"), ("1", "1", "Q2"), ("Q9", "A", "Q1")], "head string, relation string, tail string")
    got = {tuple(r)[:4]: r["score"] for r in cli.score_triples(spark, batch, vectors, relations, "transe").collect()}
    assert got[("Q1", "A", "2", 0)] == 0.0 and got[("1", "1", "Q2", 1)] == pytest.approx(-(2**0.5)) and got[("Q9", "A", "Q1", 0)] is None
    top = cli.score_relations(spark, batch.select("head", "tail"), vectors, relations, "transe", 1).collect()
    assert {(r["head"], r["tail"], r["top_relations"] and r["top_relations"][0]["relation"]) for r in top} == {("Q1", "2", "A"), ("1", "Q2", "A"), ("Q9", "Q1", None)}


def test_commands_read_their_settings(spark, small, tmp_path, capsys):
    from graphloom.plans import cli
    from graphloom.plans.graph_queries import Graph

    settings = {"split": {"train": 0.6, "val": 0.2, "test": 0.2, "seed": 3}, "sampler": {"fan_out": [2], "hops": 1, "max_nodes": 700, "max_images": 5}, "export": {"least": 500, "target": 600, "most": 900}, "score": {"scorer": "transe", "top_k": 1}}
    (tmp_path / "run.json").write_text(json.dumps(settings))
    run = lambda *words: cli.main([*map(str, words), "--config", str(tmp_path / "run.json")])
    for command in ("plan", "split", "sample"):
        assert run(command, "--tables", small, "--output", tmp_path / command) == 0
    made = {c: spark.read.parquet(f"{tmp_path}/{c}") for c in ("plan", "split", "sample")}
    assert all(500 <= r["node_count"] <= 900 for r in made["plan"].collect())
    shares = {r["split"]: r["count"] for r in made["split"].groupBy("split").count().collect()}
    assert 0.15 < shares["val"] / sum(shares.values()) <= 0.2
    images = made["sample"].join(Graph.of(spark, small).catalog.filter("has_image").select(F.col("node_idx").alias("node")), "node")
    assert made["sample"].filter("hop > 1").isEmpty() and made["sample"].groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 700
    assert images.filter("hop > 0").groupBy("batch_id").count().filter("count > 5").isEmpty()
    spark.createDataFrame([(1, "Q1", [1.0, 0.0]), (2, "Q2", [0.0, 1.0])], "node long, wid string, vector array<double>").write.parquet(f"{tmp_path}/v")
    spark.createDataFrame([(0, "A", [-1.0, 1.0]), (1, "B", [0.0, 0.0])], "r int, type string, vector array<double>").write.parquet(f"{tmp_path}/r")
    stored = ("--vectors", tmp_path / "v", "--relations", tmp_path / "r")
    run("score-triples", *stored, "--head", "Q1", "--relation", "A", "--tail", "2")
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"head": "Q1", "relation": "A", "tail": "2", "relation_idx": 0, "score": 0.0}
    run("score-relations", *stored, "--head", "Q1", "--tail", "Q2")
    assert [x["relation"] for x in json.loads(capsys.readouterr().out.splitlines()[-1])["top_relations"]] == ["A"]
    with pytest.raises(Exception, match="unknown head: Q9"):
        run("score-triples", *stored, "--head", "Q9", "--relation", "A", "--tail", "2")
    with pytest.raises(ValueError, match="--tail"):
        run("score-relations", *stored, "--head", "Q1")


def test_entities_are_encoded_once(spark, tmp_path):
    """An entity in 1000 pairs is encoded once; what is in the cache is not, and what was made is there for the next run."""
    from graphloom.operators import encoding

    entities = spark.createDataFrame([(i, f"word{i} word", [float(i), 1.0] if i % 2 else None) for i in range(30)], "node long, text string, image array<double>")
    pairs = spark.createDataFrame([(0, i % 20) for i in range(1000)] + [(5, 99)], "h long, t long")
    edges = spark.createDataFrame([(i + 1, i) for i in range(29)] + [(7, 0)], "src long, dst long")
    chain, made = encoding.Chain(size=4, missing=(0.5, -0.5)), []

    def encode(missing):
        made.append(sorted(r["node"] for r in missing.collect()))
        return chain.encode(missing, entities, edges)

    wanted = encoding.ends(pairs)
    cache = chain.encode(spark.createDataFrame([(3,), (4,), (25,)], "node long"), entities, edges)
    vectors = encoding.with_cache(wanted, cache, encode, f"{tmp_path}/cache")
    assert made == [sorted({*range(20), 99} - {3, 4})]  # each once, though 0 stands in 1000 pairs
    found = {r["node"]: r["vector"] for r in vectors.collect()}
    assert sorted(found) == list(range(20))  # 99 is no entity
    out = encoding.gathered(pairs, vectors)
    assert out.count() == 1000 and "h_vector" in out.columns
    plain = {r["node"]: r["vector"] for r in chain.features(entities).collect()}
    assert plain[2][4:] == [0.5, -0.5, 0.0] and plain[3][4:] == [3.0, 1.0, 1.0]
    near = [(a + b) / 2 for a, b in zip(plain[1], plain[7])]
    assert found[0] == pytest.approx([(x + y) / 2 for x, y in zip(plain[0], near)])
    encoding.with_cache(wanted, cache.unionByName(spark.read.parquet(f"{tmp_path}/cache")), encode)
    assert made[1] == [99]
    for fusion, graph, size in (("text", "nohop", 4), ("image", "nohop", 2), ("concat", "none", None)):
        one = encoding.Chain(fusion=fusion, graph=graph, size=4, missing=(0.5, -0.5))
        if size is None:
            with pytest.raises(ValueError, match="no graph encoder"):
                one.encode(wanted, entities, edges)
        else:
            assert {len(r["vector"]) for r in one.encode(wanted, entities, edges).collect()} == {size}
    silent = encoding.Chain(text="none", graph="nohop", size=3, missing=(0.0, 0.0)).encode(wanted, entities, edges)
    assert all(r["vector"][:3] == [0.0] * 3 for r in silent.collect())
    assert encoding.with_cache(wanted.limit(0), cache, encode).collect() == []


def test_labels_and_image_lookup(spark, tmp_path):
    """A label by itself is a list of one; images lie in the folder itself, or else below it under names that begin alike."""
    folder = tmp_path / "chunk_000001_x"
    folder.mkdir()
    (folder / "nodes.json").write_text(json.dumps({"1": {"labels": " ART", "properties": {}}, "2": {"labels": ["X", "Y"], "properties": {}}, "3": {"labels": None, "properties": {}}, "4": {"labels": [], "properties": {}}, "5": {"properties": {}}}))
    found = {r["node_id"]: r["labels"] for r in exports.nodes(spark, f"{folder}/nodes.json").collect()}
    assert found == {1: [" ART"], 2: ["X", "Y"], 3: None, 4: [], 5: None}
    files = spark.createDataFrame([(f"file:/img/{p}",) for p in ("Q1.png", "Q1_0.jpg", "sub/Q1.jpg", "Q2_7.jpg", "Q2_0.webp", "sub/Q2.png", "sub/Q3_1.bmp", "a/b/Q3_0.png", "sub/Q44.png", "Q5.txt", "Q12.png")], "path string")
    wanted = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",), ("Q4",), ("Q5",), ("Q1",), (None,)], "wid string")
    got = {r["wid"]: r["path"] and r["path"].removeprefix("file:/img/") for r in exports.image_lookup(wanted, files, "/img/").collect()}
    assert got == {"Q1": "Q1.png", "Q2": "Q2_0.webp", "Q3": "a/b/Q3_0.png", "Q4": "sub/Q44.png", "Q5": None}


def test_ledger_and_cache(spark):
    wanted = spark.createDataFrame([("Q1", 0), ("Q2", 1), ("Q1", 2), (None, 3)], "wid string, pos long")
    records = spark.createDataFrame([("Q1", 0, "ok", "u", "b"), ("Q1", 1, "error", "", ""), ("Q2", 2, "ok", "u", "b")], "wid string, pos long, status string, url string, brief string")
    assert sorted(tuple(r) for r in ledger.pending(wanted.dropna(), records).collect()) == [("Q1", 0), ("Q1", 2)]
    assert [tuple(r) for r in ledger.outputs(wanted.dropna(), records).orderBy("pos").collect()] == [(0, "Q1", "", ""), (1, "Q2", "u", "b")]


def test_streams(spark, tmp_path):
    from graphloom.streaming import ledger as S

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/events")
    query = S.windowed(stream, "1 day", "1 day", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == source.count()


def test_config():
    assert RunConfig.of({"split": {"train": 0.7, "val": 0.2}, "sampler": {"fan_out": [4]}}).sampler.fan_out == (4,)
    for broken in ({"split": {"train": 0.9}}, {"score": {"scorer": "none"}}, {"nothing": 1}, {"sampler": {"hop": 1}}, {"export": {"least": 9, "target": 1}}):
        with pytest.raises(ValueError):
            RunConfig.of(broken)


def test_plans(spark, small):
    """No plan multiplies tables, and top-k is cut before the shuffle."""
    from graphloom.plans.catalogue import QUERIES

    for name in ("triples_dedup", "split_unseen_repair", "one_hop_neighbors", "pending_work"):
        assert "CartesianProduct" not in QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in QUERIES["cross_chunk_context"](spark, small)._jdf.queryExecution().toString()


def test_every_negative_about_the_focus_has_one(spark):
    pairs = spark.createDataFrame([(i, i + 7) for i in range(0, 200, 2)], "lo long, hi long")
    focus = spark.createDataFrame([(k, 1000 + k) for k in range(20)], "place long, node long")
    others = spark.createDataFrame([(k, k) for k in range(300)], "place long, node long")
    got = negatives.of_pairs_any(pairs, pairs, focus, others, 1, num_neg=3).collect()
    assert len(got) == 300 and all(r["valid"] and r["neg_hi"] >= 1000 > r["neg_lo"] for r in got)
    assert any(r["neg_lo"] != r["lo"] for r in got) and any(r["neg_lo"] == r["lo"] for r in got)
    assert not any(r["valid"] for r in negatives.of_pairs_any(pairs, pairs, focus.limit(0), others, 1).collect())


def test_negatives_by_copies_pools_and_direction(spark):
    rows = spark.createDataFrame([(i, i % 3, i + 1) for i in range(50)], "h long, r int, t long")
    pool = spark.createDataFrame([(k, 10 * k) for k in range(8)], "place long, node long")
    got = negatives.of_triples(rows, rows, 0, 1, num_neg=4, pool=pool).collect()
    assert len(got) == 200 and {r["copy"] for r in got} == {0, 1, 2, 3}
    assert all(((r["neg_h"], r["t"]) == (r["neg_h"], r["neg_t"]) and r["neg_h"] % 10 == 0) or (r["neg_h"] == r["h"] and r["neg_t"] % 10 == 0) for r in got if r["valid"])
    with pytest.raises(ValueError):
        negatives.of_triples(rows, rows, 0, 1, pool=pool.limit(0))
    # The reverse of a known edge is a negative.
    edges = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long")
    known = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 0)], "src long, dst long")
    assert {(r["neg"], r["valid"]) for r in negatives.of_directed(edges, known, 4, 1).collect()} == {(3, True)}
    assert {r["neg"] for r in negatives.of_directed(known, edges, 3, 1).collect()} <= {0, 1, 2, None}


def test_exports_go_on_where_they_stopped(spark, tmp_path):
    nodes = spark.createDataFrame([(i, i // 10, i % 10) for i in range(60)], "node_id long, chunk_id int, chunk_pos int")
    edges = spark.createDataFrame([(i, i, (i * 7) % 60, "x") for i in range(60)], "id long, src long, dst long, type string")
    out = f"{tmp_path}/out"
    assert sharded.export_mode(spark, out) == "fresh"
    assert sharded.export_chunks(nodes, edges, out, parts=3, stop_after=1) == "fresh"
    # What a stopped run has left of a chunk is replaced.
    nodes.filter("chunk_id = 3").limit(3).write.mode("append").partitionBy("chunk_id").parquet(f"{out}/nodes")
    assert sharded.export_mode(spark, out) == "resume" and sharded.done_chunks(spark, out).count() == 2
    assert sharded.export_chunks(nodes, edges, out, parts=3) == "resume"
    assert sharded.export_chunks(nodes, edges, out, parts=3) == "completed"
    assert spark.read.parquet(f"{out}/nodes").count() == 60 == spark.read.parquet(f"{out}/edges").count()
    assert sharded.done_chunks(spark, out).count() == 6
    assert sharded.export_chunks(nodes, edges, out, overwrite=True) == "fresh"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(ValueError):
        sharded.export_mode(spark, f"{tmp_path}/other")


def test_lists_metrics_and_vectors(spark, tmp_path):
    nodes = spark.createDataFrame([(2, ["A"]), (1, [])], "node_id long, labels array<string>")
    writers.node_list(nodes, f"{tmp_path}/nodes")
    assert {r["node_id"] for r in spark.read.json(f"{tmp_path}/nodes").collect()} == {1, 2}
    for step in (1, 2):
        writers.metrics_rows(spark.createDataFrame([(step, 0.5)], "step int, auc double"), f"{tmp_path}/metrics")
    assert spark.read.option("header", True).csv(f"{tmp_path}/metrics").count() == 2
    old, new = (spark.createDataFrame(rows, "node long, vector array<float>") for rows in ([(1, [1.0]), (2, [2.0])], [(2, [3.0]), (4, [4.0])]))
    assert sorted((r["node"], r["vector"]) for r in writers.vectors_back(old, new, f"{tmp_path}/vectors").collect()) == [(1, [1.0]), (2, [3.0]), (4, [4.0])]


def test_prepared_batches(spark):
    edges = spark.createDataFrame([(s, 0, d) for i in range(40) for s, d in ((i, (i + 1) % 40), ((i + 1) % 40, i))], "src long, rel int, dst long")
    catalog = spark.createDataFrame([(i, i % 2 == 0, i % 4 == 0) for i in range(40)], "node_idx long, has_image boolean, is_art boolean")
    mine = spark.createDataFrame([(0, 3, 4), (1, 20, 21)], "batch_id long, h long, t long")
    seeds = mine.selectExpr("batch_id", "explode(array(h, t)) AS node")
    got = N.prepared(seeds, mine, edges, catalog, [5], 2, 5, 2, 1)
    counts = {r["batch_id"]: r for r in got["counts"].collect()}
    assert all(r["nodes"] <= 5 and r["images"] <= 2 for r in counts.values())
    hidden = {(0, 3, 4), (0, 4, 3), (1, 20, 21), (1, 21, 20)}
    assert not hidden & {(r["batch_id"], r["src"], r["dst"]) for r in got["edges"].collect()}
    for b, r in counts.items():
        local = sorted(x["local"] for x in got["nodes"].collect() if x["batch_id"] == b)
        assert local == list(range(r["nodes"]))
    with pytest.raises(ValueError):
        N.prepared(seeds, mine, edges, catalog, [5], 2, 1, 2, 1)


def test_items_of_node_files(spark, tmp_path):
    from graphloom.sources import exports

    node = '{"labels": [], "properties": {"wid": %s}}'
    values = ['"Q2"', '"Q1"', "7", '"Q2"', '"x"', "null"]
    rows = [node % v for v in values]
    (tmp_path / "list.json").write_text("[" + ", ".join([*rows, "null", "{}"]) + "]")
    (tmp_path / "keyed.json").write_text("{" + ", ".join(f'"{i}": {r}' for i, r in enumerate(rows)) + "}")
    for name in ("list", "keyed"):
        found = exports.node_wids(spark, str(tmp_path / f"{name}.json")).orderBy("pos").collect()
        assert [(r.wid, r.pos) for r in found] == [("Q2", 0), ("Q1", 1)]
    (tmp_path / "bad.json").write_text('"x"')
    with pytest.raises(Exception, match="neither a list nor an object"):
        exports.node_wids(spark, str(tmp_path / "bad.json")).collect()


def test_texts_by_place(spark, tmp_path):
    from graphloom.operators import texts
    from graphloom.sources import exports

    (tmp_path / "chunk_1.json").write_text('[{"wid": "Q1", "brief": "a"}, {"wid": "Q2", "brief": "b"}]')
    (tmp_path / "chunk_2.json").write_text('[{"wid": "", "brief": "c"}, {"wid": "Q1", "brief": "d"}]')
    rows = exports.text_places(spark, str(tmp_path))
    assert {tuple(r) for r in texts.text_index(rows).collect()} == {("Q1", "chunk_2", 1), ("Q2", "chunk_1", 1)}
    wanted = spark.createDataFrame([("Q1",), ("Q3",)], "wid string")
    assert {tuple(r) for r in texts.looked_up(wanted, rows, "brief").select("wid", "brief").collect()} == {("Q1", "d"), ("Q3", "")}
    with pytest.raises(ValueError):
        texts.of_chunks(rows, spark.createDataFrame([("chunk_9",)], "chunk string"))


def test_caches_are_guarded(spark, tmp_path):
    from graphloom.sources import caches

    settings = {"model": "m", "size": 2}
    folder = caches.cache_folder(str(tmp_path), settings)
    assert folder != caches.cache_folder(str(tmp_path), {"model": "n", "size": 2}) != caches.cache_folder(str(tmp_path), settings, 3)
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 2.0])], "node long, vector array<double>")
    caches.write_cache(caches.stored_vectors(rows), folder, settings)
    found = caches.read_cache(spark, folder, settings)
    assert dict(found.dtypes)["vector"] == "array<float>" and found.count() == 2
    with pytest.raises(ValueError, match="other settings"):
        caches.read_cache(spark, folder, {"model": "m", "size": 3})
    assert [r.node for r in caches.missing(found, spark.range(4).withColumnRenamed("id", "node"), "node").orderBy("node").collect()] == [0, 3]


def test_encoders_by_name(spark):
    from graphloom.operators import messages

    rows = spark.createDataFrame([(1, [0.5])], "node long, vector array<double>")
    assert messages.encoder("NoHop")(None, rows).collect() == rows.collect()
    assert messages.encoder("graphsage") is messages.sage_layer
    with pytest.raises(ValueError):
        messages.encoder("other")


def test_hits_count_whole_rows_alone(spark):
    from graphloom.operators import evaluation as E

    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "node long, vector array<double>")
    positives = spark.createDataFrame([("x", 1, 2), ("x", 2, 3)], "cell string, lo long, hi long")
    drawn = spark.createDataFrame([("x", 1, 2, 1, 4), ("x", 1, 2, 0, 1), ("x", 2, 3, 0, 2)], "cell string, lo long, hi long, neg_lo long, neg_hi long")
    rows = {r.cell: r for r in E.report(positives, drawn, vectors, 2, ["x", "y"], k=1).collect()}
    assert (rows["x"].n_pos, rows["x"].n_neg, rows["x"].hit_pos, rows["x"].hit, rows["x"].per_positive) == (2, 3, 1, 0.0, 1.5)
    assert tuple(rows["y"])[1:] == (0, 0, 0.0, 0.0, 0, 0.0, 0.0)
    nothing = E.report(positives.limit(0), drawn.limit(0), vectors, 2, ["x"]).first()
    assert nothing.n_pos == 0 and nothing.auc == 0.0


def test_rounds_of_draws_take_only_what_is_open(spark):
    seen, known = [], spark.createDataFrame([(0,), *((100 + k,) for k in range(7))], "x long")

    def draws(open_):
        tried = open_.withColumn("x", F.col("h") * 100 + F.col("try"))
        seen.append(tried.count())
        return tried

    found = negatives._first_valid(spark.range(20).withColumnRenamed("id", "h"), ["h"], draws, known, ["x"], F.lit(False), 9)
    assert {r["h"]: r["try"] for r in found.collect()} == {0: 1, 1: 7} | dict.fromkeys(range(2, 20), 0)
    assert seen == [20, 2 * 5, 3]


def test_rounds_of_negatives_do_not_join_rows_with_finds(spark):
    """Rows that no early round serves get their first valid draw later, repeated ones each; what is read last is no join."""
    pairs = spark.createDataFrame([(lo, hi) for lo in range(4) for hi in range(lo + 1, 12)] + [(0, 5), (20, 30)], "lo long, hi long")
    pool = spark.createDataFrame([(i, i) for i in range(13)], "place long, node long")
    found = negatives.of_pairs(pairs, pairs, pool, 3, tries=40)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows, known = found.collect(), {tuple(r) for r in pairs.collect()}
    assert sorted((r["lo"], r["hi"]) for r in rows) == sorted(map(tuple, pairs.collect()))
    draws = {}
    for r in pairs.distinct().crossJoin(spark.range(40).withColumnRenamed("id", "try")).withColumn("x", draw(13, 3, "lo", "hi", "try")).orderBy("try").collect():
        if r["x"] != r["lo"] and tuple(sorted((r["lo"], r["x"]))) not in known:
            draws.setdefault((r["lo"], r["hi"]), (r["try"], r["x"]))
    assert all(r["neg"] == draws.get((r["lo"], r["hi"]), (None, None))[1] and r["valid"] == (r["neg"] is not None) for r in rows)
    assert any(k >= 6 for k, _ in draws.values())


def test_pairs_are_split_without_ranking_all(spark):
    rows = spark.range(9000).select(F.col("id").alias("src"), (F.col("id") % 777 + 1).alias("dst"))
    split = splits.of_pairs(rows, 0.8, 0.1, 3)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Window") and "Aggregate" not in plan
    pairs = [tuple(r) for r in N.undirected(rows).withColumn("x", order_hash(3, "lo", "hi")).orderBy("x", "lo", "hi").select("lo", "hi").collect()]
    n, got = len(pairs), {(r["lo"], r["hi"]): r["split"] for r in split.collect()}
    assert len(got) == n == split.count()
    assert all(got[p] == ("train" if i < int(n * 0.8) else "val" if i < int(n * 0.8) + int(n * 0.1) else "test") for i, p in enumerate(pairs))
