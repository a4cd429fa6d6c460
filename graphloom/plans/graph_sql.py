"""The graph queries as DuckDB SQL."""

from __future__ import annotations


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


_KIND = lambda k, kind, key, table, label, wid, images: f"""SELECT {k} * 10000000000 + {key}::BIGINT AS node_id, ({key} // 1000)::INTEGER AS chunk_id, ({k} * 1000 + {key} % 1000)::INTEGER AS chunk_pos,
    {wid} AS wid, {label} AS label, {images} AS images FROM {table}"""  # noqa: E731
_Q = lambda k, key: f"'Q' || ({k} * 10000000000 + {key}::BIGINT)"
_NONE = "NULL::VARCHAR[]"
_IMAGES = "CASE p_size % 4 WHEN 0 THEN ['https://img.example/' || p_partkey || '.png'] WHEN 1 THEN ['ftp://x', ' HTTP://y.jpg'] WHEN 2 THEN []::VARCHAR[] END"

NODES = "nodes AS (\n" + "\nUNION ALL\n".join((
    _KIND(1, "region", "r_regionkey", "region", "'REGION'", _Q(1, "r_regionkey"), _NONE),
    _KIND(2, "nation", "n_nationkey", "nation", "'NATION'", _Q(2, "n_nationkey"), _NONE),
    _KIND(3, "supplier", "s_suppkey", "supplier", "'SUPPLIER'", "NULL", _NONE),
    _KIND(4, "customer", "c_custkey", "customer", "'CUSTOMER'", _Q(4, "(c_custkey // 2)"), _NONE),
    _KIND(5, "part", "p_partkey", "part", "CASE p_size % 3 WHEN 0 THEN ' PART' WHEN 1 THEN 'PART' ELSE 'part' END", _Q(5, "p_partkey"), _IMAGES),
    _KIND(6, "orders", "o_orderkey", "orders", "'ORDERS'", _Q(6, "o_orderkey"), _NONE),
)) + ")"

EDGES = """raw_edges AS (
SELECT 1000000000000000 + l_orderkey * 100 + l_linenumber AS id, 60000000000 + l_orderkey AS src, 50000000000 + l_partkey AS dst,
    CASE l_linenumber WHEN 6 THEN ' CONTAINS ' WHEN 7 THEN ' ' ELSE 'CONTAINS' END AS type FROM lineitem
UNION ALL SELECT 2000000000000000 + l_orderkey * 100 + l_linenumber, 50000000000 + l_partkey, 30000000000 + l_suppkey, 'SUPPLIED_BY' FROM lineitem
UNION ALL SELECT 3000000000000000 + o_orderkey, 60000000000 + o_orderkey, 40000000000 + o_custkey, 'PLACED_BY' FROM orders
UNION ALL SELECT 5000000000000000 + n_nationkey, 20000000000 + n_nationkey, 10000000000 + n_regionkey, 'IN_REGION' FROM nation
UNION ALL SELECT 4000000000000000 + 30000000000 + s_suppkey, 30000000000 + s_suppkey, 20000000000 + s_nationkey, 'IN_NATION' FROM supplier
UNION ALL SELECT 4000000000000000 + 40000000000 + c_custkey, 40000000000 + c_custkey, 20000000000 + c_nationkey, 'IN_NATION' FROM customer),
edges AS (SELECT id, src, dst, trim(type) AS type FROM raw_edges WHERE trim(type) <> '')"""

_ANY_URL = "coalesce(list_bool_or(list_transform(images, lambda x: regexp_matches(lower(trim(x)), '^https?://'))), false)"
CATALOG = f"""catalog AS (SELECT row_number() OVER (ORDER BY chunk_id, chunk_pos, node_id) - 1 AS node_idx, node_id, coalesce(wid, '') AS wid,
    {_ANY_URL} AS has_image, trim(label) = 'PART' AS is_art, chunk_id, chunk_pos FROM nodes)"""

TRIPLES = """ended AS (SELECT e.id, e.type, h.node_idx AS h, t.node_idx AS t FROM edges e JOIN catalog h ON h.node_id = e.src JOIN catalog t ON t.node_id = e.dst),
vocab AS (SELECT type, (row_number() OVER (ORDER BY min(id), type) - 1)::INTEGER AS r FROM ended GROUP BY type),
triples AS (SELECT h, r, t, min(id) AS pos FROM ended JOIN vocab USING (type) GROUP BY h, r, t)"""

GRAPH = f"{NODES},\n{EDGES}"
ALL = f"{GRAPH},\n{CATALOG},\n{TRIPLES}"
PROPAGATION = "prop AS (SELECT h AS src, r AS rel, t AS dst FROM triples UNION SELECT t, r, h FROM triples)"
PAIRS = "pairs AS (SELECT DISTINCT least(h, t) AS lo, greatest(h, t) AS hi FROM triples)"

BATCHES = f"""batches AS (SELECT (row_number() OVER (ORDER BY {hash_sql("'7:batch'", "node_idx")}, node_idx) - 1) // 512 AS batch_id, node_idx AS node
    FROM catalog)"""


def _hop(k: int, hop: int, frontier: str) -> str:
    start = hash_sql("'7:start'", "f.batch_id", "f.node")
    return f"""taken{hop} AS MATERIALIZED (SELECT f.batch_id, f.node AS src, p.rel, p.dst, {hop} AS hop FROM {frontier} f JOIN degree d ON d.src = f.node
    JOIN placed p ON p.src = f.node AND ((p.place - {start} % d.degree) + d.degree) % d.degree < least({k}, d.degree))"""


SPLIT = f"""{ALL},
shuffled AS (SELECT h, r, t, row_number() OVER (PARTITION BY r ORDER BY {hash_sql("'7'", "h", "r", "t")}, h, t) - 1 AS place, count(*) OVER (PARTITION BY r) AS size FROM triples),
counted AS (SELECT *, greatest(CASE WHEN size >= 10 THEN 1 ELSE 0 END, floor(size * 0.1::DOUBLE)) AS part FROM shuffled),
split AS (SELECT h, r, t, CASE WHEN size <= 30 OR 2 * part >= size THEN 'train' WHEN place < part THEN 'test' WHEN place < 2 * part THEN 'val' ELSE 'train' END AS split FROM counted)"""

TRAIN_PROPAGATION = "prop AS (SELECT h AS src, r AS rel, t AS dst FROM split WHERE split = 'train' UNION SELECT t, r, h FROM split WHERE split = 'train')"
SAMPLE = f"""{SPLIT}, {TRAIN_PROPAGATION}, {BATCHES},
placed AS MATERIALIZED (SELECT src, rel, dst, row_number() OVER (PARTITION BY src ORDER BY {hash_sql("'7'", "src", "rel", "dst")}, rel, dst) - 1 AS place FROM prop),
degree AS (SELECT src, count(*) AS degree FROM placed GROUP BY src),
{_hop(8, 1, "batches")},
front1 AS (SELECT DISTINCT batch_id, dst AS node FROM taken1 EXCEPT SELECT batch_id, node FROM batches),
{_hop(3, 2, "front1")},
front2 AS (SELECT DISTINCT batch_id, dst AS node FROM taken2 EXCEPT (SELECT batch_id, node FROM batches UNION ALL SELECT batch_id, node FROM front1)),
sample_nodes AS MATERIALIZED (SELECT batch_id, node, 0 AS hop FROM batches UNION ALL SELECT batch_id, node, 1 FROM front1 UNION ALL SELECT batch_id, node, 2 FROM front2),
sample_edges AS MATERIALIZED (SELECT * FROM taken1 UNION ALL SELECT * FROM taken2),
trimmed AS MATERIALIZED (SELECT batch_id, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY hop, node) AS rank FROM sample_nodes) WHERE rank <= 2000 OR hop = 0)"""

PAIR_SPLIT = f"""{ALL}, {PAIRS},
placed AS (SELECT lo, hi, row_number() OVER (ORDER BY {hash_sql("'7'", "lo", "hi")}, lo, hi) - 1 AS place, count(*) OVER () AS n FROM pairs),
split AS (SELECT lo, hi, CASE WHEN place < trunc(n * 0.8::DOUBLE) THEN 'train' WHEN place < trunc(n * 0.8::DOUBLE) + trunc(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)"""

BFS = f"""{GRAPH},
links AS (SELECT src, dst FROM raw_edges UNION SELECT dst, src FROM raw_edges),
hop0 AS (SELECT 50000000000 + p_partkey AS node FROM part ORDER BY node LIMIT 3),
hop1 AS (SELECT DISTINCT dst AS node FROM links JOIN hop0 ON src = node EXCEPT SELECT node FROM hop0),
hop2 AS (SELECT DISTINCT dst AS node FROM links JOIN hop1 ON src = node EXCEPT (SELECT node FROM hop0 UNION ALL SELECT node FROM hop1)),
reached AS (SELECT node, 0 AS hop FROM hop0 UNION ALL SELECT node, 1 FROM hop1 UNION ALL SELECT node, 2 FROM hop2)"""


def _pair_negatives(condition: str, tries: int, kind: str | None = None) -> str:
    """condition: which nodes of the catalog are the pool; kind: the relation of the positives, or all."""
    where = f"JOIN vocab USING (r) WHERE type = '{kind}'" if kind else ""
    return f"""WITH {ALL}, {PAIRS}, pool AS (SELECT row_number() OVER (ORDER BY chunk_id, chunk_pos, node_idx) - 1 AS place, node_idx AS neg FROM catalog WHERE {condition}),
positives AS (SELECT DISTINCT least(h, t) AS lo, greatest(h, t) AS hi FROM triples {where}),
draws AS (SELECT lo, hi, k, neg FROM (SELECT p.lo, p.hi, k, {hash_sql("'7'", 'p.lo', 'p.hi', 'k')} % (SELECT count(*) FROM pool) AS place FROM positives p, range({tries}) AS x(k)) JOIN pool USING (place)),
good AS (SELECT lo, hi, arg_min(neg, k) AS neg FROM draws d WHERE neg <> lo AND NOT EXISTS (SELECT 1 FROM pairs z WHERE z.lo = least(d.lo, neg) AND z.hi = greatest(d.lo, neg)) GROUP BY lo, hi)
SELECT p.lo, p.hi, neg, neg IS NOT NULL AS valid FROM positives p LEFT JOIN good g ON g.lo = p.lo AND g.hi = p.hi"""


# One end is a focus node: both ends are drawn, or the lesser stays and a focus node is drawn.
_ANY_NEGATIVES = f"""WITH {ALL}, {PAIRS}, focus AS (SELECT row_number() OVER (ORDER BY chunk_id, chunk_pos, node_idx) - 1 AS place, node_idx AS node FROM catalog WHERE is_art),
rest AS (SELECT row_number() OVER (ORDER BY chunk_id, chunk_pos, node_idx) - 1 AS place, node_idx AS node FROM catalog WHERE NOT is_art),
places AS (SELECT p.lo, p.hi, k, {hash_sql("'7:side'", 'p.lo', 'p.hi')} % 2 = 0 AS both_drawn, {hash_sql("'7'", 'p.lo', 'p.hi', 'k')} % (SELECT count(*) FROM focus) AS x,
    {hash_sql("'7:other'", 'p.lo', 'p.hi', 'k')} % (SELECT count(*) FROM rest) AS y FROM pairs p, range(100) AS z(k)),
ends AS (SELECT lo, hi, k, f.node AS art, CASE WHEN both_drawn THEN o.node ELSE lo END AS other FROM places JOIN focus f ON f.place = x JOIN rest o ON o.place = y),
draws AS (SELECT lo, hi, k, least(art, other) AS neg_lo, greatest(art, other) AS neg_hi FROM ends WHERE art <> other),
good AS (SELECT lo, hi, arg_min(neg_lo, k) AS neg_lo, arg_min(neg_hi, k) AS neg_hi FROM draws d WHERE NOT EXISTS (SELECT 1 FROM pairs z WHERE z.lo = neg_lo AND z.hi = neg_hi) GROUP BY lo, hi)
SELECT p.lo, p.hi, neg_lo, neg_hi, neg_lo IS NOT NULL AS valid FROM pairs p LEFT JOIN good g ON g.lo = p.lo AND g.hi = p.hi"""


_SIDE = f"{hash_sql("'7:side'", 'p.h', 'p.r', 'p.t')} % 2 = 0"
_OTHER = f"{hash_sql("'7'", 'p.h', 'p.r', 'p.t', 'k')} % (SELECT count(*) FROM catalog)"

SQL = {
    "graph_totals": f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM raw_edges) AS n_edges",
    "node_label_counts": f"WITH {GRAPH} SELECT label AS labels, count(*) AS cnt FROM nodes GROUP BY label ORDER BY cnt DESC, labels LIMIT 10",
    "edge_type_counts": f"WITH {GRAPH} SELECT type, count(*) AS cnt FROM edges GROUP BY type ORDER BY cnt DESC, type LIMIT 10",
    "entity_catalog": f"WITH {GRAPH}, {CATALOG} SELECT * FROM catalog",
    "image_flags": f"""WITH {GRAPH} SELECT trim(label) = 'PART' AS exact, upper(label) = 'PART' AS any_case, {_ANY_URL} AS any_url,
        coalesce(len(images) > 0 AND list_bool_and(list_transform(images, lambda x: regexp_matches(lower(trim(x)), '^https?://'))), false) AS all_urls, count(*) AS n FROM nodes GROUP BY ALL""",
    "wid_lookup": f"WITH {GRAPH}, {CATALOG} SELECT wid, min(node_idx) AS node_idx FROM catalog WHERE wid <> '' GROUP BY wid",
    "relation_vocab": f"WITH {ALL} SELECT type, r FROM vocab",
    "triples_dedup": f"WITH {ALL} SELECT h, r, t, pos FROM triples",
    "edge_endpoint_filter": f"""WITH {GRAPH}, {CATALOG}, first AS (SELECT node_id FROM catalog WHERE chunk_id = 0)
        SELECT type, count(*) AS n, count(*) FILTER (src IN (SELECT node_id FROM first) AND dst IN (SELECT node_id FROM first)) AS kept FROM edges GROUP BY type""",
    "resolve_refs": f"""WITH {ALL}, wids AS (SELECT wid, min(node_idx) AS node_idx FROM catalog WHERE wid <> '' GROUP BY wid),
        refs AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Q' || (40000000000 + user_id) WHEN 1 THEN (40000000000 + user_id)::VARCHAR ELSE 'nobody' END AS ref,
            CASE event_id % 3 WHEN 0 THEN 'CONTAINS' WHEN 1 THEN '3' ELSE 'nothing' END AS relation FROM events)
        SELECT event_id, coalesce(w.node_idx, c.node_idx) AS node_idx, coalesce(v.r, n.r) AS r FROM refs LEFT JOIN wids w ON w.wid = ref LEFT JOIN catalog c ON c.node_id = TRY_CAST(ref AS BIGINT)
        LEFT JOIN vocab v ON v.type = relation LEFT JOIN vocab n ON n.r = TRY_CAST(relation AS INTEGER)""",
    "art_subsets": f"""WITH {ALL}, flagged AS (SELECT x.r, a.is_art AS ha, b.is_art AS ta FROM triples x JOIN catalog a ON a.node_idx = x.h JOIN catalog b ON b.node_idx = x.t)
        SELECT 'global' AS subset, r, count(*) AS n FROM flagged GROUP BY r UNION ALL SELECT 'art_art', r, count(*) FROM flagged WHERE ha AND ta GROUP BY r
        UNION ALL SELECT 'art_any', r, count(*) FROM flagged WHERE ha OR ta GROUP BY r""",
    "undirected_dedup": f"WITH {ALL}, {PAIRS} SELECT lo, hi FROM pairs",
    "propagation_edges": f"WITH {ALL}, {PROPAGATION} SELECT src, rel, dst FROM prop",
    "degree_distribution": f"""WITH {GRAPH}, degrees AS (SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN raw_edges ON src = node_id GROUP BY node_id)
        SELECT degree, count(*) AS n FROM degrees GROUP BY degree""",
    "csr_row_ptr": f"""WITH {GRAPH}, degrees AS (SELECT chunk_id, node_id, count(src) AS degree FROM nodes LEFT JOIN raw_edges ON src = node_id GROUP BY ALL)
        SELECT chunk_id, node_id, degree, coalesce(sum(degree) OVER (PARTITION BY chunk_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr FROM degrees""",
    "chunk_shares": f"""WITH {GRAPH}, counts AS (SELECT chunk_id, count(*) AS n FROM raw_edges JOIN nodes ON node_id = src GROUP BY chunk_id)
        SELECT chunk_id, n, round(n / sum(n) OVER (), 6) AS share FROM counts""",
    "chunk_plan": f"""WITH {GRAPH}, total AS (SELECT count(*) AS n FROM nodes),
        count_ AS (SELECT n, least(greatest(greatest(1, round_even(n / 2000, 0)::BIGINT), ceil(n / 3000)::BIGINT), greatest(1, n // 1000)) AS c FROM total),
        placed AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS place FROM nodes),
        chunked AS (SELECT node_id, CASE WHEN place < (n % c) * (n // c + 1) THEN place // (n // c + 1) ELSE n % c + (place - (n % c) * (n // c + 1)) // (n // c) END AS chunk_index FROM placed, count_)
        SELECT chunk_index, count(*) AS node_count, min(node_id) AS low, max(node_id) AS high, printf('chunk_%06d_nid_%010d_%010d', chunk_index, min(node_id), max(node_id)) AS name FROM chunked GROUP BY chunk_index""",
    "chunk_manifest": f"""WITH {GRAPH}, own AS (SELECT chunk_id, count(*) AS edge_count FROM raw_edges JOIN nodes ON node_id = src GROUP BY chunk_id)
        SELECT chunk_id, count(*) AS node_count, coalesce(any_value(edge_count), 0) AS edge_count, min(node_id) AS low, max(node_id) AS high FROM nodes LEFT JOIN own USING (chunk_id) GROUP BY chunk_id""",
    "manifest_faults": "SELECT 'node counts' AS fault, 'broken' AS manifest",
    "edge_lines": f"""WITH {GRAPH} SELECT a.label AS src_type, b.label AS dst_type, type, count(*) AS n, min(src) AS src, max(dst) AS dst
        FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst GROUP BY ALL""",
    "export_resume": f"WITH {GRAPH} SELECT node_id, chunk_id FROM nodes WHERE node_id > 50000000000",
    "one_hop_neighbors": f"""WITH {GRAPH}, ends AS (SELECT src AS node, dst AS other, type FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE src <> dst)
        SELECT node, type, count(*) AS n, count(DISTINCT other) AS others FROM ends WHERE node // 10000000000 = 5 GROUP BY ALL""",
    "bfs_two_hop": f"WITH {BFS} SELECT node, hop FROM reached",
    "bfs_subgraph": f"""WITH {BFS}, ends AS (SELECT src AS node, dst AS other, id, type FROM edges UNION ALL SELECT dst, src, id, type FROM edges WHERE src <> dst)
        SELECT node AS src, other AS dst, id, type FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY hop, e.node, other) AS k FROM ends e JOIN reached r ON r.node = e.node WHERE hop < 2) WHERE k = 1""",
    "khop_sample": f"WITH {SAMPLE} SELECT batch_id, node, hop FROM sample_nodes",
    "khop_edges": f"WITH {SAMPLE} SELECT batch_id, src, rel, dst, hop FROM sample_edges",
    "khop_trim": f"WITH {SAMPLE} SELECT batch_id, node, hop FROM trimmed",
    "image_trim": f"""WITH {SAMPLE}, flagged AS (SELECT s.*, has_image, is_art FROM sample_nodes s JOIN catalog ON node_idx = node),
        images AS (SELECT batch_id, count(*) FILTER (has_image) AS images FROM flagged GROUP BY batch_id),
        gone AS (SELECT batch_id, node, row_number() OVER (PARTITION BY batch_id ORDER BY is_art DESC, CASE WHEN is_art THEN {hash_sql("'7:23'", "node")} ELSE {hash_sql("'7:29'", "node")} END, node) AS rank FROM flagged WHERE has_image AND hop > 0)
        SELECT batch_id, node, hop FROM sample_nodes ANTI JOIN (SELECT batch_id, node FROM gone JOIN images USING (batch_id) WHERE rank <= images - 100) USING (batch_id, node)""",
    "induced_subgraph": f"""WITH {SAMPLE}, local AS MATERIALIZED (SELECT batch_id, node, (row_number() OVER (PARTITION BY batch_id ORDER BY hop, node) - 1)::INTEGER AS local FROM trimmed),
        starts AS MATERIALIZED (SELECT e.*, local AS src_local FROM sample_edges e JOIN local a ON a.batch_id = e.batch_id AND a.node = src)
        SELECT e.*, local AS dst_local FROM starts e JOIN local b ON b.batch_id = e.batch_id AND b.node = dst""",
    "leakage_mask": f"""WITH {SAMPLE}, hidden AS (SELECT b.batch_id, least(h, t) AS lo, greatest(h, t) AS hi FROM batches b JOIN triples ON h = b.node JOIN vocab USING (r) WHERE type = 'IN_NATION')
        SELECT * FROM sample_edges e WHERE NOT EXISTS (SELECT 1 FROM hidden x WHERE x.batch_id = e.batch_id AND lo = least(src, dst) AND hi = greatest(src, dst))""",
    "intra_chunk_edges": f"""WITH {GRAPH} SELECT a.chunk_id, count(*) AS n, sum(a.chunk_pos)::BIGINT AS src_sum, sum(b.chunk_pos)::BIGINT AS dst_sum
        FROM raw_edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.chunk_id = b.chunk_id GROUP BY a.chunk_id""",
    "cross_chunk_context": f"""WITH {ALL}, ends AS (SELECT h AS src, t AS dst FROM triples UNION SELECT t, h FROM triples),
        ranked AS (SELECT a.chunk_id, src AS node, dst AS other, row_number() OVER (PARTITION BY src ORDER BY b.is_art DESC, {hash_sql("'7'", "src", "dst")}, dst) AS rank
            FROM ends JOIN catalog a ON a.node_idx = src JOIN catalog b ON b.node_idx = dst WHERE a.chunk_id <> b.chunk_id)
        SELECT chunk_id, node, other FROM ranked WHERE rank <= 4""",
    "split_relation_stratified": f"WITH {SPLIT} SELECT h, r, t, split FROM split",
    "split_unseen_repair": f"""WITH {SPLIT}, seen AS (SELECT h AS node FROM split WHERE split = 'train' UNION SELECT t FROM split WHERE split = 'train')
        SELECT h, r, t, CASE WHEN a.node IS NOT NULL AND b.node IS NOT NULL THEN split ELSE 'train' END AS split FROM split LEFT JOIN seen a ON a.node = h LEFT JOIN seen b ON b.node = t""",
    "split_undirected": f"WITH {PAIR_SPLIT} SELECT lo, hi, split FROM split",
    "split_overlap": f"""WITH {PAIR_SPLIT}, names AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS x(first, second))
        SELECT first, second, (SELECT count(*) FROM split a JOIN split b ON a.lo = b.lo AND a.hi = b.hi WHERE a.split = first AND b.split = second) AS n FROM names""",
    "epoch_batches": f"""WITH {ALL} SELECT h, r, t, (row_number() OVER (ORDER BY {hash_sql("'7:1'", "h", "r", "t")}, h, r, t) - 1) // 512 AS batch_id FROM triples""",
    "neg_kge": f"""WITH {ALL}, positives AS (SELECT h, r, t FROM triples),
        draws AS (SELECT p.h, p.r, p.t, k, CASE WHEN {_SIDE} THEN {_OTHER} ELSE p.h END AS neg_h, CASE WHEN {_SIDE} THEN p.t ELSE {_OTHER} END AS neg_t FROM positives p, range(50) AS x(k)),
        good AS (SELECT *, row_number() OVER (PARTITION BY h, r, t ORDER BY k) AS n FROM draws d WHERE neg_h <> neg_t AND NOT EXISTS (SELECT 1 FROM triples z WHERE z.h = d.neg_h AND z.r = d.r AND z.t = d.neg_t))
        SELECT p.h, p.r, p.t, neg_h, neg_t, neg_h IS NOT NULL AS valid FROM positives p LEFT JOIN (SELECT * FROM good WHERE n = 1) g ON g.h = p.h AND g.r = p.r AND g.t = p.t""",
    "neg_uniform": _pair_negatives("TRUE", 50),
    "neg_art": _pair_negatives("is_art", 100),
    "neg_art_any": _ANY_NEGATIVES,
    "neg_candidate_pool": _pair_negatives("node_id BETWEEN 20000000000 AND 20000000003", 3, "IN_NATION"),
}
