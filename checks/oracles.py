"""The same results in DuckDB SQL, over the same whole tables.

Trees are found by Boruvka rounds over all pairs, with components of the chosen edges
by a recursive query; nothing is shared with the Spark side but the tie order.
"""

from __future__ import annotations

# Rounds suffice for 2**ROUNDS nodes.
ROUNDS = 12

EMB = "SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings"
BLOCKS = "(SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) FROM embeddings)"
CODE = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0.0::DOUBLE WHEN 'BUILDING' THEN 1.0::DOUBLE "
    "WHEN 'FURNITURE' THEN 2.0::DOUBLE WHEN 'HOUSEHOLD' THEN 3.0::DOUBLE END"
)
ALL_CODE = CODE.replace(" END", " WHEN 'MACHINERY' THEN 4.0::DOUBLE END")
CUST = f"SELECT c_custkey AS id, [{ALL_CODE}, c_acctbal / 1000, c_nationkey::DOUBLE] AS x FROM customer"
RAW_CUST = (
    f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, [{ALL_CODE}, c_acctbal, c_nationkey::DOUBLE] AS x "
    "FROM customer"
)
MAPPED = (
    f"SELECT c_custkey AS id, [{CODE}, c_acctbal / 1000, c_nationkey::DOUBLE] AS x FROM customer "
    f"WHERE {CODE} IS NOT NULL AND c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)"
)
FLAGGED = (
    "SELECT l_partkey + ascii(l_returnflag) * 10000000000 AS l, "
    "l_suppkey + 1000000000 + ascii(l_returnflag) * 10000000000 AS r, l_extendedprice AS w FROM lineitem"
)
TIED = "SELECT p_partkey AS id, [p_size::DOUBLE] AS x FROM part"
DIST = (
    "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
)
SUPPLY = (
    "SELECT l_partkey AS l, l_suppkey + 1000000000 AS r, l_extendedprice AS w, "
    "l_orderkey * 10 + l_linenumber AS place FROM lineitem"
)


def dist(a: str, b: str) -> str:
    return DIST.format(a=a, b=b)


def all_pairs(points: str) -> str:
    """CTEs ``pts(id, x)`` and ``p(l, r, w)``: every pair of points once."""
    return f"""pts AS MATERIALIZED ({points}),
p AS MATERIALIZED (SELECT a.id AS l, b.id AS r, {dist('a.x', 'b.x')} AS w
  FROM pts a JOIN pts b ON a.id < b.id)"""


def by_subgraph(where: str = "true", key: str = "sg") -> str:
    """CTEs ``pts``, ``q`` (pairs with their subgraph) and ``p`` with nodes per group.

    A node of group g is written g * 1000000 + id, so groups are separate components.
    """
    return f"""pts AS MATERIALIZED ({EMB}),
q AS MATERIALIZED (SELECT a.id AS l, b.id AS r, {dist('a.x', 'b.x')} AS w,
    least(a.id % s, b.id % s) AS lo, greatest(a.id % s, b.id % s) AS hi,
    CASE WHEN lo = hi THEN s * (s - 1) // 2 + lo ELSE hi * (hi - 1) // 2 + lo END AS sg
  FROM pts a JOIN pts b ON a.id < b.id, (SELECT {BLOCKS} AS s)),
p AS MATERIALIZED (SELECT {key} * 1000000 + l AS l, {key} * 1000000 + r AS r, w FROM q WHERE {where})"""


def forest(edges: str = "p", name: str = "mst", x: str = "") -> str:
    """CTEs that end in ``name(l, r, w)``, the minimum spanning forest of ``edges``.

    ``x`` sets the names of the rounds apart where a query finds two forests.
    """
    parts = [f"e{x}0 AS MATERIALIZED (SELECT l, r, w, l AS cl, r AS cr FROM {edges} WHERE l <> r)"]
    for i in range(ROUNDS):
        parts.append(f"""b{x}{i} AS MATERIALIZED (SELECT c, min({{'w': w, 'l': l, 'r': r, 'o': o}}) AS e FROM (
  SELECT cl AS c, cr AS o, w, l, r FROM e{x}{i} UNION ALL SELECT cr, cl, w, l, r FROM e{x}{i}) GROUP BY c),
t{x}{i} AS MATERIALIZED (SELECT a.c, CASE WHEN z.e.o = a.c AND a.c < a.e.o THEN a.c ELSE a.e.o END AS up
  FROM b{x}{i} a JOIN b{x}{i} z ON z.c = a.e.o),
u{x}{i}(c, up) AS (SELECT c, up FROM t{x}{i} UNION ALL
  SELECT u.c, t.up FROM u{x}{i} u JOIN t{x}{i} t ON u.up = t.c WHERE t.up <> t.c),
n{x}{i} AS MATERIALIZED (SELECT u.c, u.up FROM u{x}{i} u JOIN t{x}{i} t ON u.up = t.c AND t.up = t.c),
e{x}{i + 1} AS MATERIALIZED (SELECT * FROM (SELECT l, r, w, i1.up AS cl, i2.up AS cr
  FROM e{x}{i} JOIN n{x}{i} i1 ON i1.c = e{x}{i}.cl JOIN n{x}{i} i2 ON i2.c = e{x}{i}.cr) WHERE cl <> cr)""")
    picks = " UNION ".join(f"SELECT e.l AS l, e.r AS r, e.w AS w FROM b{x}{i}" for i in range(ROUNDS))
    parts.append(f"{name} AS MATERIALIZED ({picks})")
    return ",\n".join(parts)


def labels(nodes: str, edges: str) -> str:
    """CTE ``comp(id, component)``: smallest reachable id over edges ``(l, r)``."""
    return f"""ends AS MATERIALIZED (SELECT l AS a, r AS b FROM ({edges}) UNION SELECT r, l FROM ({edges})),
reach(n, c) AS (SELECT id, id FROM ({nodes}) UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.n),
comp AS MATERIALIZED (SELECT n AS id, min(c) AS component FROM reach GROUP BY n)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


MST = with_(all_pairs(EMB), forest())
SUBTREES = with_(by_subgraph(), forest(), "sub AS MATERIALIZED (SELECT l // 1000000 AS subgraph, "
                 "l % 1000000 AS l, r % 1000000 AS r, w FROM mst)")
FACTS = "SELECT id, CAST(pos AS INTEGER) AS pos, round(x[pos + 1], 6) AS x FROM (SELECT *, unnest(range(len(x))) AS pos FROM "
EDGES = "SELECT l AS left, r AS right, round(w, 6) AS weight FROM mst"
NEAR = with_(all_pairs(EMB), forest(), labels("SELECT id FROM pts", "SELECT * FROM mst WHERE w < 1.2"))
CUT10 = with_(
    all_pairs(EMB), forest(),
    "kept AS MATERIALIZED (SELECT * FROM mst ORDER BY w DESC, l DESC, r DESC OFFSET 9)",
    labels("SELECT id FROM pts", "SELECT * FROM kept"),
)
PAIR_FACTS = (
    "count(*) AS pairs, round(min(w), 6) AS shortest, round(max(w), 6) AS longest, round(sum(w), 4) AS total"
)
# One state row per node and step: the cluster that holds the node before that step.
LINKAGE = with_(
    all_pairs(EMB), forest(),
    "ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, l, r) - 1 AS step, l, r, w FROM mst)",
    "size AS MATERIALIZED (SELECT count(*) AS n FROM pts)",
    """st(step, id, c) AS (SELECT 0::BIGINT, id, id FROM pts UNION ALL
  SELECT s.step + 1, s.id, CASE WHEN s.c = x.c OR s.c = y.c THEN size.n + s.step ELSE s.c END
  FROM st s JOIN ranked k ON k.step = s.step JOIN st x ON x.id = k.l JOIN st y ON y.id = k.r, size)""",
    """link AS MATERIALIZED (SELECT k.step, least(x.c, y.c) AS child_a, greatest(x.c, y.c) AS child_b, k.w AS height
  FROM ranked k JOIN st x ON x.step = k.step AND x.id = k.l JOIN st y ON y.step = k.step AND y.id = k.r)""",
    """sizes AS MATERIALIZED (SELECT step - 1 AS step, count(*) AS size FROM st, size
  WHERE step > 0 AND c = n + step - 1 GROUP BY ALL)""",
)
# Matrix rows: squared norms, and dot products of rows that share a column.
ROW_PAIRS = with_(
    all_pairs(EMB), forest(),
    "adj AS MATERIALIZED (SELECT l AS i, r AS j, w AS v FROM mst WHERE w <> 0 UNION ALL SELECT r, l, w FROM mst WHERE w <> 0)",
    "norm AS MATERIALIZED (SELECT id, coalesce(sum(v * v), 0.0) AS n2 FROM pts LEFT JOIN adj ON i = id GROUP BY id)",
    "dot AS MATERIALIZED (SELECT a.i AS l, b.i AS r, sum(a.v * b.v) AS d FROM adj a JOIN adj b ON a.j = b.j AND a.i < b.i GROUP BY ALL)",
    """rp AS MATERIALIZED (SELECT a.id AS l, b.id AS r,
  sqrt(greatest(a.n2 + b.n2 - 2 * coalesce(d, 0.0), 0.0)) AS w
  FROM norm a JOIN norm b ON a.id < b.id LEFT JOIN dot ON dot.l = a.id AND dot.r = b.id)""",
)


# How the rows that become one pair of clusters are put together, and the height of a pair.
# ``own`` is the size of the end that was merged, ``far`` that of the other end.
UNITED = {
    "average": ("sum(d)", "d / (na * nb)"),
    "complete": ("max(d)", "d"),
    "weighted": ("avg(d)", "d"),
    "ward": (
        "CASE WHEN bool_or(touched) THEN greatest((sum((own + far) * d) - any_value(far) * any_value(e.h)) "
        "/ (any_value(e.na + e.nb) + any_value(far)), 0) ELSE any_value(d) END",
        "d",
    ),
}


def greedy(edges: str, method: str) -> str:
    """CTE ``merges``: greedy linkage over pairs ``(l, r, w)`` of nodes 0..n-1.

    A row of the recursion is a pair of clusters with the sum (average), the greatest
    (complete), the mean (weighted) or the square (ward) of its distances; each step merges
    the nearest pair and puts the rows together that become the same pair.
    """
    unite, height = UNITED[method]
    start, end = ("w * w", "sqrt(any_value(md))") if method == "ward" else ("w", "any_value(md)")
    return f"""total AS MATERIALIZED (SELECT count(*) AS n FROM pts),
g(step, a, b, d, na, nb, ma, mb, md, ms) AS (
  SELECT 0::BIGINT, l, r, {start}, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT FROM {edges}
  UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), {unite}, any_value(CASE WHEN x < y THEN nx ELSE ny END),
    any_value(CASE WHEN x < y THEN ny ELSE nx END), any_value(e.a), any_value(e.b), any_value(e.h), any_value(e.na + e.nb)
  FROM (SELECT g.step, g.d, e, n, CASE WHEN g.a IN (e.a, e.b) THEN n + g.step ELSE g.a END AS x,
      CASE WHEN g.b IN (e.a, e.b) THEN n + g.step ELSE g.b END AS y,
      CASE WHEN g.a IN (e.a, e.b) THEN e.na + e.nb ELSE g.na END AS nx,
      CASE WHEN g.b IN (e.a, e.b) THEN e.na + e.nb ELSE g.nb END AS ny,
      g.a IN (e.a, e.b) OR g.b IN (e.a, e.b) AS touched,
      CASE WHEN g.a IN (e.a, e.b) THEN g.na ELSE g.nb END AS own,
      CASE WHEN g.a IN (e.a, e.b) THEN g.nb ELSE g.na END AS far
    FROM g, (SELECT min({{'h': {height}, 'a': a, 'b': b, 'na': na, 'nb': nb}}) AS e FROM g WHERE a <> b), total)
  WHERE e IS NOT NULL GROUP BY step, least(x, y), greatest(x, y)),
merges AS MATERIALIZED (SELECT step - 1 AS step, any_value(ma) AS child_a, any_value(mb) AS child_b,
  {end} AS height, any_value(ms) AS size FROM g WHERE step > 0 GROUP BY step)"""


def average(edges: str) -> str:
    return greedy(edges, "average")


def cut_merges(k: int) -> str:
    """CTE ``comp(id, component)``: leaves by the cluster that holds them when ``k`` are left."""
    return labels(
        "SELECT id FROM pts UNION ALL SELECT n + step FROM merges, total",
        f"SELECT unnest([child_a, child_b]) AS l, n + step AS r FROM merges, total WHERE step < n - {k}",
    ).replace("comp AS", "every AS") + ",\ncomp AS MATERIALIZED (SELECT every.id, component FROM every JOIN pts USING (id))"


SQUARED = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def silhouette(distance: str, name: str) -> str:
    return f"""WITH pts AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
n AS (SELECT label, count(*) AS k FROM pts GROUP BY label),
d AS MATERIALIZED (SELECT a.id, a.label AS own, b.label AS other, sum({distance}) AS total
  FROM pts a JOIN pts b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT d.id, d.own, max(CASE WHEN own = other THEN total / (k - 1) END) AS a,
  min(CASE WHEN own <> other THEN total / k END) AS b FROM d JOIN n ON n.label = d.other GROUP BY ALL)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS {name} FROM s"""


SIZES = f"""WITH k AS (SELECT {BLOCKS} AS s), b AS (SELECT unnest(range({BLOCKS})) AS o)
SELECT CASE WHEN id % s = o THEN s * (s - 1) // 2 + o ELSE greatest(id % s, o) * (greatest(id % s, o) - 1) // 2 + least(id % s, o) END AS subgraph,
  count(*) AS points FROM ({EMB}), b, k GROUP BY ALL"""
STEPS = LINKAGE + "SELECT step, child_a, child_b, round(height, 6) AS height, size FROM link JOIN sizes USING (step)"
MERGES = "SELECT step, child_a, child_b, round(height, 6) AS height, size FROM merges"
ROW_MERGES = ROW_PAIRS.rstrip() + ",\n" + average("rp") + "\n" + MERGES
NON_CYCLE = with_(f"p AS MATERIALIZED (SELECT l, r, place::DOUBLE AS w FROM ({SUPPLY}))", forest()) + (
    "SELECT l AS left, r AS right, w::BIGINT AS place FROM mst"
)
FLAG_COMPONENTS = with_(
    f"p AS MATERIALIZED ({FLAGGED})", forest(), labels("SELECT l AS id FROM p UNION SELECT r FROM p", "SELECT * FROM mst")
) + "SELECT id, component FROM comp"


def merged(method: str) -> str:
    return with_(all_pairs(EMB), greedy("p", method)) + MERGES


def row_silhouette(*clusters: str) -> str:
    """Silhouette of adjacency rows under the labels that ``clusters`` leave in ``comp``."""
    return ROW_PAIRS.rstrip() + ",\n" + ",\n".join(clusters) + """,
k AS (SELECT component AS label, count(*) AS k FROM comp GROUP BY ALL),
d AS MATERIALIZED (SELECT id, own, other, sum(w) AS total FROM (
  SELECT l AS id, a.component AS own, b.component AS other, w FROM rp JOIN comp a ON a.id = l JOIN comp b ON b.id = r
  UNION ALL SELECT r, b.component, a.component, w FROM rp JOIN comp a ON a.id = l JOIN comp b ON b.id = r) GROUP BY ALL),
s AS (SELECT d.id, max(CASE WHEN own = other THEN total / (k - 1) END) AS a,
  min(CASE WHEN own <> other THEN total / k END) AS b FROM d JOIN k ON k.label = d.other GROUP BY ALL)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""


def kept_rows(rest: str) -> tuple[str, str, str]:
    """Components of the row tree's edges that are left by ``rest``."""
    kept = f"kept AS MATERIALIZED (SELECT * FROM rows {rest})"
    return forest("rp", "rows", "r"), kept, labels("SELECT id FROM pts", "SELECT * FROM kept")


ORACLES = {
    "a1_read_csv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "a2_read_points_bin": f"{FACTS} ({EMB}))",
    "a3_write_points_bin": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size::DOUBLE AS x FROM part",
    "a4_write_points": f"SELECT CAST(id % 4 AS INTEGER) AS block, * FROM ({FACTS} ({EMB})))",
    "a5_read_points": f"{FACTS} ({EMB})) WHERE id % 4 IN (1, 2)",
    "a6_points_text": f"{FACTS} ({EMB}))",
    "a8_edges_text": MST + "SELECT printf('[(%d %d) %f]', l, r, w) AS value FROM mst",
    "a9_csv_to_tree": with_(all_pairs(RAW_CUST), forest()) + EDGES,
    "b1_drop_incomplete": f"SELECT c_custkey, {CODE} AS segment, c_acctbal FROM customer WHERE segment IS NOT NULL AND c_acctbal IS NOT NULL AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0",
    "b2_encode_category": f"SELECT c_custkey, {CODE} AS segment FROM customer",
    "b3_to_double": f"SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, {CODE} AS c_mktsegment FROM customer",
    "b4_drop_columns": "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "b5_assemble_points": f"SELECT id, x[1] AS segment, round(x[2], 6) AS balance, x[3] AS nation FROM ({MAPPED})",
    "b6_with_dense_id": "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer",
    "b7_first_points": f"{FACTS} ({EMB})) WHERE id < 100",
    "b8_first_dims": f"{FACTS} (SELECT id, x[1:16] AS x FROM ({EMB})))",
    "b9_edge_columns": SUBTREES + "SELECT l AS left, r AS right, round(w, 6) AS weight FROM sub",
    "b10_profile": "SELECT count(*) AS rows, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, 'id bigint, coords array<double>' AS column_types FROM embeddings",
    "b11_preview": f"{FACTS} (SELECT * FROM ({EMB}) ORDER BY id LIMIT 5))",
    "c1_assign_blocks": f"SELECT vec_id AS id, CAST(vec_id % {BLOCKS} AS INTEGER) AS block FROM embeddings",
    "c2_subgraph_count": f"SELECT {BLOCKS} AS blocks, {BLOCKS} * ({BLOCKS} - 1) // 2 + {BLOCKS} AS subgraphs",
    "c3_subgraph_plan": f"""WITH b AS (SELECT unnest(range({BLOCKS})) AS i),
k AS (SELECT {BLOCKS} AS s)
SELECT y.i * (y.i - 1) // 2 + x.i AS subgraph, x.i::INTEGER AS low, y.i::INTEGER AS high, true AS is_bipartite FROM b x JOIN b y ON x.i < y.i
UNION ALL SELECT s * (s - 1) // 2 + i, i::INTEGER, i::INTEGER, false FROM b, k""",
    "c4_points_by_subgraph": f"""WITH k AS (SELECT {BLOCKS} AS s), b AS (SELECT unnest(range({BLOCKS})) AS o)
SELECT CASE WHEN id % s = o THEN s * (s - 1) // 2 + o ELSE greatest(id % s, o) * (greatest(id % s, o) - 1) // 2 + least(id % s, o) END AS subgraph,
  CASE WHEN id % s <= o THEN 0 ELSE 1 END AS side, id FROM ({EMB}), b, k""",
    "c5_subgraph_sizes": SIZES,
    "c5_subgraph_sizes_delivered": SIZES,
    "d1_euclidean": f"WITH e AS ({EMB}) SELECT a.id, round({dist('a.x', 'b.x')}, 6) AS weight FROM e a JOIN e b ON b.id = a.id + 1",
    "d2_distance": f"""WITH e AS ({EMB}) SELECT a.id, step, CASE WHEN step = 0 THEN 0.0::DOUBLE ELSE round({dist('a.x', 'b.x')}, 6) END AS weight
FROM e a JOIN e b ON b.id = a.id + 1, (SELECT unnest([0, 1]) AS step)""",
    "d3_pairs_within": with_(by_subgraph()) + f"SELECT sg AS subgraph, {PAIR_FACTS} FROM q WHERE lo = hi GROUP BY sg",
    "d4_pairs_between": with_(by_subgraph()) + f"SELECT sg AS subgraph, {PAIR_FACTS} FROM q WHERE lo < hi GROUP BY sg",
    "d5_complete_graph": with_(all_pairs(EMB)) + f"SELECT {PAIR_FACTS} FROM p",
    "d6_nearest_outside": with_(all_pairs(EMB)) + """SELECT c AS id, e.o AS nearest, round(e.w, 6) AS weight FROM (
SELECT c, min({'w': w, 'l': l, 'r': r, 'o': o}) AS e FROM (SELECT l AS c, r AS o, w, l, r FROM p UNION ALL SELECT r, l, w, l, r FROM p) GROUP BY c)""",
    "d7_dimension": f"SELECT id, CAST(len(x) AS INTEGER) AS dim FROM ({EMB})",
    "d8_same_point": "SELECT vec_id AS id, label % 2 = 0 AS same FROM embeddings",
    "d9_point_hash": f"SELECT id, id * 163 + len(x) * 57 + CAST(trunc(list_sum(x)) AS BIGINT) AS hash FROM ({EMB})",
    "e1_clique_mst": with_(by_subgraph("lo = hi"), forest()) + "SELECT l // 1000000 AS subgraph, l % 1000000 AS left, r % 1000000 AS right, round(w, 6) AS weight FROM mst",
    "e2_bipartite_mst": with_(by_subgraph("lo < hi"), forest()) + "SELECT l // 1000000 AS subgraph, l % 1000000 AS left, r % 1000000 AS right, round(w, 6) AS weight FROM mst",
    "e3_subgraph_mst": SUBTREES + "SELECT subgraph, l AS left, r AS right, round(w, 6) AS weight FROM sub",
    "e4_canonical_edge": "SELECT least(l_suppkey, l_partkey) AS left, greatest(l_suppkey, l_partkey) AS right, l_quantity AS weight FROM lineitem",
    "e5_sort_edges": MST + EDGES,
    "e6_edges_by_subgraph": SUBTREES + """SELECT subgraph, count(*)::INTEGER AS edges, f.l AS first_left, round(f.w, 6) AS lightest, t.r AS last_right, round(t.w, 6) AS heaviest FROM (
SELECT subgraph, min({'w': w, 'l': l, 'r': r}) AS f, max({'w': w, 'l': l, 'r': r}) AS t FROM sub GROUP BY subgraph) JOIN sub USING (subgraph) GROUP BY ALL""",
    "e7_merge_msts": with_(by_subgraph(key="(sg // 4)"), forest()) + "SELECT l // 1000000 AS subgraph, l % 1000000 AS left, r % 1000000 AS right, round(w, 6) AS weight FROM mst",
    "e7_merge_msts_rounds": with_(by_subgraph(key="(sg // 4)"), forest()) + "SELECT l // 1000000 AS subgraph, l % 1000000 AS left, r % 1000000 AS right, round(w, 6) AS weight FROM mst",
    "e9_merge_tree_rounds": MST + EDGES,
    "e12_mst_of_edges_rounds": with_(f"p AS MATERIALIZED ({SUPPLY})", forest()) + EDGES,
    "e8_regroup": SUBTREES + "SELECT subgraph // 4 AS subgraph, count(*) AS edges FROM sub GROUP BY ALL",
    "e9_merge_tree": MST + EDGES,
    "e10_mst": MST + EDGES,
    "e10_mst_auto": MST + EDGES,
    "e10_mst_pruned": with_(all_pairs(CUST), forest()) + EDGES,
    "e10_mst_tied": with_(all_pairs(TIED), forest()) + "SELECT l AS left, r AS right, w AS weight FROM mst",
    "e11_mst_direct": MST + EDGES,
    "e11_mst_direct_pruned": with_(all_pairs(CUST), forest()) + EDGES,
    "e12_mst_of_edges": with_(f"p AS MATERIALIZED ({SUPPLY})", forest()) + EDGES,
    "f1_components": NEAR + "SELECT id, component FROM comp",
    "f1_components_supply": FLAG_COMPONENTS,
    "f1_components_rounds": FLAG_COMPONENTS,
    "f2_component_count": NEAR + "SELECT count(DISTINCT component) AS components FROM comp",
    "f3_connected": NEAR + "SELECT id AS u, id + 1 AS v, component = (SELECT component FROM comp b WHERE b.id = comp.id + 1) AS connected FROM comp",
    "f4_non_cycle_edges": NON_CYCLE,
    "f4_non_cycle_edges_rounds": NON_CYCLE,
    "g1_edge_counts": SUBTREES + "SELECT subgraph, count(*) AS edges FROM sub GROUP BY ALL",
    "g2_first_edges": SUBTREES + "SELECT subgraph, row_number() OVER (PARTITION BY subgraph ORDER BY w, l, r)::INTEGER AS position, l AS left, r AS right, round(w, 6) AS weight FROM sub QUALIFY position <= 3",
    "g3_total_weight": MST + "SELECT round(sum(w), 6) AS total_weight FROM mst",
    "g4_graph_size": MST + "SELECT count(DISTINCT id) AS nodes, (SELECT count(*) FROM mst) AS edges FROM (SELECT l AS id FROM mst UNION ALL SELECT r FROM mst)",
    "g4_graph_size_supply": f"WITH p AS ({SUPPLY}) SELECT count(DISTINCT id) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT l, r FROM p)) AS edges FROM (SELECT l AS id FROM p UNION ALL SELECT r FROM p)",
    "g5_compare_graphs": MST.rstrip() + """, t AS (SELECT count(*) AS e, sum(w) AS w FROM mst),
n AS (SELECT count(DISTINCT id) AS n FROM (SELECT l AS id FROM mst UNION ALL SELECT r FROM mst)),
m AS (SELECT count(*) AS e FROM mst WHERE l <> (SELECT min(l) FROM mst))
SELECT 'other blocks' AS against, e + 1 = n AS same FROM t, n UNION ALL SELECT 'other weights', w = 0 FROM t
UNION ALL SELECT 'an edge more', t.e = t.e + 1 FROM t UNION ALL SELECT 'fewer nodes', m.e = t.e FROM m, t""",
    "g6_edge_diff": with_(
        all_pairs(EMB), forest(),
        f"c AS MATERIALIZED (SELECT l, r, w FROM p, (SELECT {BLOCKS} AS s) WHERE l % s = r % s)",
        forest("c", "cliques", "k"),
    ) + """SELECT 'a' AS side, l AS left, r AS right, round(w, 6) AS weight, 1::BIGINT AS copies FROM (SELECT * FROM mst EXCEPT SELECT * FROM cliques)
UNION ALL SELECT 'b', l, r, round(w, 6), 1 FROM (SELECT * FROM cliques EXCEPT SELECT * FROM mst)""",
    "h1_adjacency": with_(all_pairs(TIED), forest()) + "SELECT l AS row, r AS col, round(w, 6) AS value FROM mst WHERE w <> 0 UNION ALL SELECT r, l, round(w, 6) FROM mst WHERE w <> 0",
    "h2_adjacency_row_pairs": ROW_PAIRS + f"""SELECT CASE WHEN lo = hi THEN s * (s - 1) // 2 + lo ELSE hi * (hi - 1) // 2 + lo END AS subgraph, {PAIR_FACTS}
FROM (SELECT w, s, least(l % s, r % s) AS lo, greatest(l % s, r % s) AS hi FROM rp, (SELECT {BLOCKS} AS s)) GROUP BY subgraph""",
    "h2_adjacency_row_tree": ROW_PAIRS.rstrip() + ",\n" + forest("rp", "rows", "r") + "\nSELECT row_number() OVER (ORDER BY w) - 1 AS place, round(w, 4) AS weight FROM rows",
    "h3_linkage": STEPS,
    "h3_linkage_levels": STEPS,
    "h4_agglomerate": merged("average"),
    "h4_agglomerate_rounds": merged("average"),
    "h4_complete": merged("complete"),
    "h4_weighted": merged("weighted"),
    "h4_ward": merged("ward"),
    "h4_agglomerate_tied": """WITH RECURSIVE p AS (SELECT p_size::DOUBLE AS x, count(*) AS k FROM part GROUP BY 1),
pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first) - 1 AS id, x, k FROM
  (SELECT p_size::DOUBLE AS x, count(*) AS k, min(p_partkey) AS first FROM part GROUP BY 1)),
total AS (SELECT count(*) AS n FROM pts),
g(step, a, b, d, na, nb, md) AS (
  SELECT 0::BIGINT, y.id, z.id, abs(y.x - z.x) * y.k * z.k, y.k, z.k, NULL::DOUBLE FROM pts y JOIN pts z ON y.id < z.id
  UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), sum(d), any_value(CASE WHEN x < y THEN nx ELSE ny END),
    any_value(CASE WHEN x < y THEN ny ELSE nx END), any_value(e.h)
  FROM (SELECT g.step, g.d, e, CASE WHEN g.a = e.b THEN e.a ELSE g.a END AS x, CASE WHEN g.b = e.b THEN e.a ELSE g.b END AS y,
      CASE WHEN g.a IN (e.a, e.b) THEN e.na + e.nb ELSE g.na END AS nx,
      CASE WHEN g.b IN (e.a, e.b) THEN e.na + e.nb ELSE g.nb END AS ny
    FROM g, (SELECT min({'h': round(d / (na * nb), 9), 'a': a, 'b': b, 'na': na, 'nb': nb}) AS e FROM g WHERE a <> b))
  WHERE e IS NOT NULL GROUP BY step, least(x, y), greatest(x, y)),
h AS (SELECT any_value(md) AS h FROM g WHERE step > 0 GROUP BY step UNION ALL SELECT unnest(repeat([0.0], (k - 1)::INT)) FROM pts)
SELECT round(h, 6) AS height, count(*) AS steps, true AS same FROM h GROUP BY 1""",
    "h5_adjacency_linkage": ROW_MERGES,
    "h5_adjacency_linkage_rounds": ROW_MERGES,
    "h6_dendrogram_layout": LINKAGE.rstrip() + """,
whole AS MATERIALIZED (SELECT id AS node, 1 AS size, 0.0::DOUBLE AS height FROM pts UNION ALL SELECT n + step, sizes.size, height FROM link JOIN sizes USING (step), size),
kids AS MATERIALIZED (SELECT n + step AS node, child_a, child_b, whole.size AS skip FROM link JOIN whole ON whole.node = child_a, size),
place(node, first) AS (SELECT max(node), 0::BIGINT FROM whole UNION ALL
  SELECT unnest([child_a, child_b]), unnest([first, first + skip]) FROM place JOIN kids USING (node))
SELECT node, first, size::BIGINT AS size, round(height, 6) AS x, round(first * 10 + size * 5, 6)::DOUBLE AS y FROM place JOIN whole USING (node)""",
    "h7_cut_clusters": CUT10 + "SELECT id, component FROM comp",
    "h8_cut_threshold": with_(all_pairs(EMB), forest(), labels("SELECT id FROM pts", "SELECT * FROM mst WHERE w < 1.15")) + "SELECT id, component FROM comp",
    "h9_labels": CUT10 + "SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp",
    "h10_cluster_points": with_(
        all_pairs(CUST), forest(),
        "kept AS MATERIALIZED (SELECT * FROM mst ORDER BY w DESC, l DESC, r DESC OFFSET 4)",
        labels("SELECT id FROM pts", "SELECT * FROM kept"),
    ) + "SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp",
    "h10_cluster_points_average": with_(all_pairs(EMB), average("p"), cut_merges(7))
    + "SELECT id, dense_rank() OVER (ORDER BY least_id) - 1 AS label FROM "
    "(SELECT id, min(id) OVER (PARTITION BY component) AS least_id FROM comp)",
    "h11_cut_linkage_threshold": with_(all_pairs(EMB), forest(), labels("SELECT id FROM pts", "SELECT * FROM mst WHERE w < 1.15"))
    + "SELECT id, component FROM comp",
    "h11_cut_linkage": CUT10 + "SELECT id, component FROM comp",
    "h12_cluster_sizes": CUT10 + "SELECT label, count(*) AS points FROM (SELECT dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp) GROUP BY label",
    "i1_silhouette": silhouette(dist("a.x", "b.x"), "silhouette"),
    "i2_adjacency_silhouette": row_silhouette(*kept_rows("ORDER BY w DESC, l DESC, r DESC OFFSET 2")),
    "i2_adjacency_silhouette_threshold": row_silhouette(*kept_rows("WHERE w < 2.5")),
    "i2_adjacency_silhouette_average": row_silhouette(average("rp"), cut_merges(5)),
    "i3_silhouette_fast": silhouette(SQUARED, "silhouette_squared"),
}

