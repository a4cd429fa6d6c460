"""The queries on vectors, texts and events as DuckDB SQL."""

from __future__ import annotations

from .graph_sql import hash_sql


def _total(terms: str, over: str, n: int) -> str:
    """A sum of `terms` for i in 1 to n, from the left."""
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {terms}))"


def _layer(row: list[float], x: str, offset: int = 0) -> str:
    return " + ".join(f"{x}[{i + 1 + offset}] * ({w}::DOUBLE)" for i, w in enumerate(row))


OWN = [[0.5, -0.25, 0.125, 1.0] * 16, [1.0, 0.5, -0.5, 0.25] * 16]
NEIGHBOUR = [[0.25, 0.5, -1.0, 0.125] * 16, [-0.5, 1.0, 0.25, 0.5] * 16]
BIAS = [0.1, -0.2]
_OTHER = lambda *key: f"{hash_sql("'11'", *key)} % (SELECT count(*) FROM embeddings)"
_R = lambda x: f"round({x}, 6) + 0.0"

VECTORS = f"""ent AS (SELECT vec_id AS node, embedding::DOUBLE[] AS vector, label FROM embeddings),
dims AS (SELECT node, label, unnest(range(64))::INTEGER AS dim, unnest(vector) AS x FROM ent),
rels AS (SELECT label AS r, list(x ORDER BY dim) AS vector FROM (SELECT label, dim, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY label),
queries AS (SELECT node AS qid, node AS h, {_OTHER("node")} AS t, label AS r FROM ent),
known AS (SELECT h, t, r FROM queries UNION SELECT h, t, (r + 1) % 10 FROM queries WHERE h % 2 = 0),
links AS (SELECT DISTINCT node AS src, {_OTHER("node", "k")} AS dst, (k % 3)::INTEGER AS rel FROM ent, range(1, 6) AS x(k))"""

_TRANSE = f"-sqrt({_total('(a.vector[i] + c.vector[i] - b.vector[i]) * (a.vector[i] + c.vector[i] - b.vector[i])', '', 64)}) + 0.0"
_C = "a.vector[i]*c.vector[i]*b.vector[i] + a.vector[i+32]*c.vector[i]*b.vector[i+32] + a.vector[i]*c.vector[i+32]*b.vector[i+32] - a.vector[i+32]*c.vector[i+32]*b.vector[i]"
_COMPLEX = _total(_C, "", 32)
_ENDS = "JOIN ent a ON a.node = h JOIN ent b ON b.node = t"
_ALL_R = lambda score: f"cand AS (SELECT qid, h, t, c.r, {score} AS score FROM (SELECT qid, h, t FROM queries) {_ENDS} CROSS JOIN rels c)"
_LABELLED = lambda score: f"""tails AS (SELECT qid, h, r, t, 1 AS label FROM queries UNION ALL SELECT qid, h, r, {_OTHER("h", "k")}, 0 FROM queries, range(1, 21) AS x(k)),
labelled AS (SELECT qid, h, x.r, t, x.label, {score} AS score FROM tails x {_ENDS} JOIN rels c ON c.r = x.r)"""  # noqa: E731
_RANKS = """goal AS (SELECT q.qid, q.r, c.score FROM queries q JOIN cand c ON c.qid = q.qid AND c.r = q.r),
left_ AS (SELECT c.*, g.r AS target, g.score AS goal FROM cand c JOIN goal g USING (qid) WHERE c.r = g.r OR NOT EXISTS (SELECT 1 FROM known k WHERE k.h = c.h AND k.t = c.t AND k.r = c.r)),
ranks AS (SELECT qid, target AS r, 1 + count(*) FILTER (score > goal) AS rank, arg_max(r, struct_pack(s := score, n := -r)) AS top1 FROM left_ GROUP BY qid, target)"""
_SUBSETS = """flags AS (SELECT qid, x.label % 2 = 0 AS hf, y.label % 2 = 0 AS tf FROM queries JOIN ent x ON x.node = h JOIN ent y ON y.node = t),
subsets AS (SELECT 'global' AS subset, qid FROM flags UNION ALL SELECT 'art_art', qid FROM flags WHERE hf AND tf UNION ALL SELECT 'art_any', qid FROM flags WHERE hf OR tf)"""


def auc_sql(group: str, source: str) -> str:
    return f"""cells AS (SELECT {group} AS g, score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM {source} GROUP BY ALL),
sums AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM cells WINDOW w AS (PARTITION BY g ORDER BY score DESC))
SELECT g AS {group.split('.')[-1]}, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 0.5 ELSE {_R("sum(n * (tp - p / 2.0)) / (sum(p)::DOUBLE * sum(n))")} END AS auc,
CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 0.0 ELSE {_R("sum(p * (tp / (tp + fp))) / sum(p)")} END AS ap FROM sums GROUP BY g"""


_MEAN = "means AS (SELECT dst AS node, dim, avg(x) AS x FROM links JOIN dims ON dims.node = src GROUP BY ALL)"
_RELMEAN = "means AS (SELECT dst AS node, rel, dim, avg(x) AS x FROM links JOIN dims ON dims.node = src GROUP BY ALL)"


def _bag(size: int) -> str:
    return f"""bags AS (SELECT node, list_transform(range({size}), lambda i: len(list_filter(b, lambda z: z = i))::DOUBLE) AS v FROM (SELECT doc_id AS node, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\t\\n\\x0b\\f\\r ]+'), lambda w: w <> ''),
    lambda w: ('0x' || substr(md5(w), 1, 15))::BIGINT % {size}) AS b FROM documents)),
text_vectors AS (SELECT node, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1)) AS v FROM bags)"""


_RECORDS = """records AS (SELECT 'Q' || user_id AS wid, event_id AS pos, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_sitelink' WHEN 2 THEN 'error' END AS status,
CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS url, CASE WHEN event_id % 5 > 0 THEN event_type ELSE ' ' END AS brief FROM events),
last AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY wid ORDER BY pos DESC) = 1),
wanted AS (SELECT 'Q' || c_custkey AS wid, c_custkey AS pos FROM customer)"""
_TERMINAL = "CASE WHEN coalesce(status, '') = 'ok' THEN TRUE WHEN status = 'no_sitelink' THEN trim(brief) <> '' ELSE url <> '' OR trim(brief) <> '' END"
# White space of Unicode, which \\s leaves out.
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
_CLEAN = f"trim(regexp_replace(regexp_replace(' ' || chr(9) || '[12]' || coalesce(text, '') || chr(10) || chr(10) || ' end[3] ', '\\[\\d+\\]', '', 'g'), '{_SPACES}', ' ', 'g'))"
_ASSEMBLED = "array_to_string(list_filter(list_transform([text, lang, '  ', ' ' || source], lambda x: trim(coalesce(x, ''), ' ')), lambda x: x <> ''), chr(10))"
_SOME = lambda k, c: f"CASE WHEN p_partkey % {k} > 0 THEN {c} END"
_FULL = lambda x: f"regexp_replace(trim({x}), '\\.+$', '') || '.'"


_ENCODED = """encoded AS (SELECT e.node, CASE WHEN m IS NULL THEN e.vector ELSE list_transform(range(1, 65), lambda i: (e.vector[i] + m[i]) / 2) END AS vector
FROM ent e LEFT JOIN (SELECT node, list(x ORDER BY dim) AS m FROM means GROUP BY node) USING (node))"""


def _graph(query: str) -> str:
    """A query with graph-encoded entities at both ends."""
    return query.replace(f"WITH {VECTORS}", f"WITH {VECTORS}, {_MEAN}, {_ENCODED}").replace("JOIN ent a", "JOIN encoded a").replace("JOIN ent b", "JOIN encoded b")


def _relational(o: int) -> str:
    mixes = {0: [1.0, 0.0], 1: [0.5, 0.5], 2: [-0.25, 2.0]}
    cases = " ".join(f"WHEN {rel} THEN ({_layer(OWN[o], 'v')}) * {a} + ({_layer(NEIGHBOUR[o], 'v')}) * {b}" for rel, (a, b) in mixes.items())
    return f"CASE rel {cases} END"


SQL = {
    "relation_centroids": f"WITH {VECTORS} SELECT label AS r, dim, {_R('avg(x)')} AS x FROM dims GROUP BY ALL",
    "transe_scores": f"WITH {VECTORS} SELECT qid, h, t, q.r, {_R(_TRANSE)} AS score FROM queries q {_ENDS} JOIN rels c ON c.r = q.r",
    "complex_scores": f"WITH {VECTORS} SELECT qid, h, t, q.r, {_R(_COMPLEX)} AS score FROM queries q {_ENDS} JOIN rels c ON c.r = q.r",
    "relation_topk": f"WITH {VECTORS}, {_ALL_R(_COMPLEX)} SELECT qid, r, rank::INTEGER AS rank, {_R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r) AS rank FROM cand) WHERE rank <= 3",
    "relation_rank_filtered": f"WITH {VECTORS}, {_ALL_R(_TRANSE)}, {_RANKS} SELECT qid, r, rank, top1 FROM ranks",
    "mrr_hits": f"""WITH {VECTORS}, {_ALL_R(_TRANSE)}, {_RANKS}, {_SUBSETS} SELECT subset, count(*) AS n, {_R('avg(1.0::DOUBLE / rank)')} AS mrr, {_R('avg((rank <= 1)::INTEGER)')} AS hits_1, {_R('avg((rank <= 3)::INTEGER)')} AS hits_3,
        {_R('avg((rank <= 10)::INTEGER)')} AS hits_10, {_R('avg((top1 = r)::INTEGER)')} AS top1 FROM ranks JOIN subsets USING (qid) GROUP BY subset""",
    "triple_auc_ap": f"WITH {VECTORS}, {_LABELLED(_TRANSE)}, {auc_sql('r', 'labelled')}",
    "subset_metrics": f"WITH {VECTORS}, {_LABELLED(_TRANSE)}, {_SUBSETS}, joined AS (SELECT * FROM labelled JOIN subsets USING (qid)), {auc_sql('subset', 'joined')}",
    "hit_at_10": f"""WITH {VECTORS}, {_LABELLED(_TRANSE)}, {_SUBSETS}, pos AS (SELECT qid, score AS goal FROM labelled WHERE label = 1),
        hits AS (SELECT qid, 1 + count(*) FILTER (label = 0 AND score >= goal) AS rank FROM labelled JOIN pos USING (qid) GROUP BY qid)
        SELECT subset, count(*) AS n, {_R('avg((rank <= 10)::INTEGER)')} AS hit FROM hits JOIN subsets USING (qid) GROUP BY subset""",
    "triple_loss": f"WITH {VECTORS}, {_LABELLED(_COMPLEX)} SELECT r, {_R('avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score))))')} AS loss FROM labelled GROUP BY r",
    "mean_aggregate": f"WITH {VECTORS}, {_MEAN} SELECT node, dim, {_R('x')} AS x FROM means",
    "relational_mean_aggregate": f"WITH {VECTORS}, {_RELMEAN} SELECT node, rel, dim, {_R('x')} AS x FROM means",
    "sage_layer": f"""WITH {VECTORS}, {_MEAN}, lists AS (SELECT node, list(x ORDER BY dim) AS v FROM means GROUP BY node),
        rows AS (SELECT e.node, e.vector AS w, coalesce(v, list_transform(range(64), lambda i: 0.0)) AS v FROM ent e LEFT JOIN lists USING (node))
        {' UNION ALL '.join(f"SELECT node, {o} AS dim, {_R(f'{_layer(OWN[o], "w")} + ({BIAS[o]}::DOUBLE) + ({_layer(NEIGHBOUR[o], "v")})')} AS x FROM rows" for o in (0, 1))}""",
    "relational_layer": f"""WITH {VECTORS}, {_RELMEAN}, lists AS (SELECT node, rel, list(x ORDER BY dim) AS v FROM means GROUP BY ALL),
        sums AS (SELECT node, {', '.join(f"sum({_relational(o)}) AS m{o}" for o in (0, 1))} FROM lists GROUP BY node)
        {' UNION ALL '.join(f"SELECT e.node, {o} AS dim, {_R(f'{_layer(OWN[o], "e.vector")} + ({BIAS[o]}::DOUBLE) + coalesce(m{o}, 0)')} AS x FROM ent e LEFT JOIN sums USING (node)" for o in (0, 1))}""",
    "pair_scores": f"""WITH {VECTORS} SELECT qid, {_R(' + '.join(f"greatest({_layer(OWN[o], 'a.vector')} + {_layer(NEIGHBOUR[o], 'b.vector')} + ({BIAS[o]}::DOUBLE), 0) * ({w}::DOUBLE)" for o, w in ((0, 1.5), (1, -0.5))) + ' + 0.25')} AS score FROM queries {_ENDS}""",
    "fused_features": f"""WITH {VECTORS}, rows AS (SELECT node, list_concat(vector[1:40], CASE WHEN node % 3 > 0 THEN vector[41:63] ELSE list_transform(range(23), lambda i: 0.75) END, [CASE WHEN node % 3 > 0 THEN 1.0 ELSE 0.0 END]) AS v FROM ent)
        {' UNION ALL '.join(f"SELECT node, {o} AS dim, {_R(f'greatest({_layer(OWN[o], "v")} + ({BIAS[o]}::DOUBLE), 0)')} AS x FROM rows" for o in (0, 1))}""",
    "text_vectors": f"WITH {_bag(8)} SELECT node, unnest(range(8))::INTEGER AS dim, {_R('unnest(v)')} AS x FROM text_vectors",
    "embedding_fill": f"WITH {_bag(64)} SELECT node, {_R('list_sum(coalesce(embedding::DOUBLE[], v))')} AS sum FROM text_vectors LEFT JOIN embeddings ON vec_id = node",
    "pair_encoding": f"""WITH {VECTORS}, {_bag(8)}, features AS (SELECT e.node, list_concat(coalesce(t.v, list_transform(range(8), lambda i: 0.0)), CASE WHEN e.node % 3 > 0 THEN e.vector[1:4] ELSE [0.75, 0.0, -0.5, 0.25] END,
            [CASE WHEN e.node % 3 > 0 THEN 1.0 ELSE 0.0 END]) AS v FROM ent e LEFT JOIN text_vectors t ON t.node = e.node),
        spread AS (SELECT node, unnest(range(13)) AS dim, unnest(v) AS x FROM features), means AS (SELECT node, list(x ORDER BY dim) AS m FROM (SELECT dst AS node, dim, avg(x) AS x FROM links JOIN spread ON spread.node = src GROUP BY ALL) GROUP BY node),
        encoded AS (SELECT f.node, CASE WHEN m IS NULL THEN v ELSE list_transform(range(1, 14), lambda i: (v[i] + m[i]) / 2) END AS v FROM features f LEFT JOIN means USING (node))
        SELECT qid, h, t, {_R('list_sum(list_transform(range(1, 14), lambda i: a.v[i] * b.v[i]))')} AS score FROM queries JOIN encoded a ON a.node = h JOIN encoded b ON b.node = t""",
    "cache_hits": f"SELECT count(*) FILTER (v) AS hits, count(*) FILTER (NOT v) AS misses, {_R('count(*) FILTER (v) / count(*)')} AS rate FROM (SELECT doc_id IN (SELECT vec_id FROM embeddings) AS v FROM documents)",
    "text_clean": f"SELECT doc_id, length({_CLEAN})::INTEGER AS n, md5({_CLEAN}) AS md5 FROM documents",
    "text_assemble": f"SELECT doc_id, length({_ASSEMBLED})::INTEGER AS n, md5({_ASSEMBLED}) AS md5 FROM documents",
    "time_format": """WITH rows AS (SELECT o_orderkey, o_orderkey % 7 + 6 AS p, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END AS s, o_orderdate AS d FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN p >= 11 THEN s || strftime(d, '%Y-%m-%d') WHEN p = 10 THEN s || strftime(d, '%Y-%m') WHEN p = 8 THEN 'circa ' || s || year(d) || 's'
            WHEN p = 7 AND s = '-' THEN 'circa ' || year(d) || ' BC' WHEN p = 7 THEN 'circa AD ' || year(d) ELSE s || year(d) END AS text FROM rows""",
    "fallback_brief": f"""SELECT p_partkey, concat_ws(' ', {_FULL(f"coalesce({_SOME(7, "p_name || '..'")}, 'Q' || p_partkey)")}, {_FULL(_SOME(3, 'p_type'))}, 'Created ' || {_SOME(4, 'p_size')} || '.', 'Discovered ' || {_SOME(5, 'p_size')} || '.',
        coalesce('Held by ' || {_SOME(6, 'p_brand')} || ', inventory no. ' || {_SOME(2, 'p_size')} || '.', 'Inventory no. ' || {_SOME(2, 'p_size')} || '.'), 'Country: ' || {_SOME(8, 'p_brand')} || '.',
        CASE WHEN p_partkey % 3 > 0 THEN printf('Coordinates: %.6f, %.6f.', p_size / 8.0::DOUBLE, p_size / -4.0::DOUBLE) END) AS brief FROM part""",
    "image_files": """WITH rows AS (SELECT *, CASE WHEN event_id % 13 > 0 THEN ['.png', '.jpeg', NULL, '.svg', '.jpg', '.gif'][event_id % 6 + 1] END AS e, CASE WHEN event_id % 4 > 0 THEN 'Q' || user_id || '_2' END AS w FROM events)
        SELECT event_id, coalesce(w, 'node_' || user_id) || e AS file, CASE WHEN event_id % 4 > 0 THEN 'Q' || user_id END AS wid, 'org__' || event_type || '__v_1.0' AS slug, 'https://x/' || event_type || '_of_' || user_id AS page,
        printf('%d:%02d:%02d', (user_id * 61) // 3600, (user_id * 61) // 60 % 60, user_id * 61 % 60) AS took, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 1000000000 END::BIGINT AS chunk FROM rows""",
    "latest_record_per_key": f"WITH {_RECORDS} SELECT * FROM last",
    "terminal_flags": f"WITH {_RECORDS} SELECT pos, {_TERMINAL} AS terminal, TRUE AS item, pos % 2 = 0 AS dropped FROM records",
    "pending_work": f"WITH {_RECORDS} SELECT wid, pos FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.wid = w.wid AND {_TERMINAL})",
    "text_outputs": f"WITH {_RECORDS} SELECT w.pos, w.wid, coalesce(url, '') AS url, coalesce(brief, '') AS brief FROM wanted w LEFT JOIN last l ON l.wid = w.wid",
    "ordered_distinct": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
    "best_path_pick": """WITH rows AS (SELECT 'Q' || user_id AS wid, event_type, 'Q' || user_id || CASE event_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '_0.png' WHEN 2 THEN '_3.jpg' ELSE '_' || event_id || '.webp' END AS name, least(event_id % 4, 2) AS rank FROM events)
        SELECT wid, '/img/' || event_type || '/' || name AS path FROM rows QUALIFY row_number() OVER (PARTITION BY wid ORDER BY CASE WHEN regexp_replace(name, '\\.[^.]*$', '') = wid THEN 0 WHEN regexp_replace(name, '\\.[^.]*$', '') = wid || '_0' THEN 1 ELSE 2 END, name, event_type) = 1""",
    "preferred_statement": "SELECT user_id, coalesce(min(event_id) FILTER (event_id % 7 = 0), min(event_id)) AS event_id FROM events GROUP BY user_id",
    "rolling_stats": f"""SELECT event_type, event_id, {_R('avg(value) OVER w')} AS mean, {_R('stddev_pop(value) OVER w')} AS std, {_R('var_pop(value) OVER w')} AS var FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "early_stop_trace": """WITH RECURSIVE means AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, round(avg(value), 6) AS value FROM events GROUP BY ALL),
        rows AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS k FROM means),
        trace AS (SELECT event_type, step, value, k, value AS best, TRUE AS improved, 0 AS idle, FALSE AS stopped FROM rows WHERE k = 1
            UNION ALL SELECT r.event_type, r.step, r.value, r.k, CASE WHEN r.value > t.best + 0.5 THEN r.value ELSE t.best END, r.value > t.best + 0.5,
                CASE WHEN r.value > t.best + 0.5 THEN 0 ELSE t.idle + 1 END, t.stopped OR (r.value <= t.best + 0.5 AND t.idle + 1 >= 5) FROM trace t JOIN rows r ON r.event_type = t.event_type AND r.k = t.k + 1)
        SELECT event_type, step, value, best, improved, idle, stopped FROM trace""",
    "eval_first_rows": "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000",
    "seed_pick": f"(SELECT c_custkey, 'product' AS how FROM customer ORDER BY c_custkey LIMIT 50) UNION ALL (SELECT c_custkey, 'hash' AS how FROM customer ORDER BY {hash_sql("'11'", 'c_custkey')}, c_custkey LIMIT 50)",
    "work_batches": "SELECT c_custkey, chunk, (row_number() OVER (PARTITION BY chunk ORDER BY c_custkey) - 1) // 100 AS batch FROM (SELECT c_custkey, c_custkey // 1000 AS chunk FROM customer)",
}
SQL |= {f"{name}_graph": _graph(SQL[of]) for name, of in (("relation_topk", "relation_topk"), ("relation_rank", "relation_rank_filtered"), ("triple_auc_ap", "triple_auc_ap"))}
