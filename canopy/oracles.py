"""DuckDB SQL that the queries are compared with: recursive closures and interval
joins, written independently of how the operators work."""

_HEAP = """h AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey > 0 THEN CAST((p_partkey - 1) // 3 AS BIGINT) END AS parent_id,
         CAST(p_size AS INTEGER) AS size, p_brand AS brand, p_type AS type, p_name AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
         CAST(p_partkey % 7 + 1 AS BIGINT) AS weight, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS INTEGER) END AS score, p_partkey % 3 = 0 AS flag
  FROM part
)"""


def _closure(name: str, nodes: str) -> str:
    return f"""{name} AS (
  SELECT id AS node, id AS anc, 0 AS dist FROM {nodes}
  UNION ALL SELECT x.node, p.parent_id, x.dist + 1 FROM {name} AS x JOIN {nodes} AS p ON p.id = x.anc WHERE p.parent_id IS NOT NULL
)"""


def _placed(nodes: str, cl: str, order: str, tag: str = "") -> str:
    """CTEs that number ``nodes`` (siblings by ``order``): place<tag> has id, lft, rgt, depth."""
    return f"""path{tag} AS (
  SELECT c.node, list([CAST({order} AS DOUBLE), CAST(a.id AS DOUBLE)] ORDER BY c.dist DESC) AS way, max(c.dist) AS depth FROM {cl} AS c JOIN {nodes} AS a ON a.id = c.anc GROUP BY c.node
), rank{tag} AS (SELECT node, depth, row_number() OVER (ORDER BY way) - 1 AS k FROM path{tag}),
size{tag} AS (SELECT anc AS node, count(*) AS s FROM {cl} GROUP BY anc),
place{tag} AS (
  SELECT r.node AS id, CAST(2 * k - depth + 1 AS BIGINT) AS lft, CAST(2 * k - depth + 2 * s AS BIGINT) AS rgt, CAST(depth AS INTEGER) AS depth
  FROM rank{tag} AS r JOIN size{tag} AS s ON s.node = r.node
)"""


def heap(select: str) -> str:
    """``select`` over t (the numbered heap) and cl (its closure)."""
    return f"WITH RECURSIVE {_HEAP}, {_closure('cl', 'h')}, {_placed('h', 'cl', 'a.id')}, t AS (SELECT h.*, lft, rgt, depth FROM h JOIN place USING (id))\n{select}"


def rebuilt(nodes: str, select: str = "SELECT id, parent_id, lft, rgt, depth FROM t") -> str:
    """``select`` over t, the tree of other nodes (id, parent_id, pos) made from the
    heap h and its closure hc."""
    return f"""WITH RECURSIVE {_HEAP}, {_closure('hc', 'h')}, n AS ({nodes}), {_closure('cl', 'n')}, {_placed('n', 'cl', 'a.pos')},
t AS (SELECT CAST(n.id AS BIGINT) AS id, CAST(n.parent_id AS BIGINT) AS parent_id, lft, rgt, depth FROM n JOIN place ON place.id = n.id)
{select}"""


_CORRUPT = """c AS (
  SELECT id, CASE WHEN id % 71 = 17 THEN id + 10000000 ELSE parent_id END AS parent_id,
         CASE WHEN id % 97 = 5 THEN rgt WHEN id % 89 = 7 THEN lft + 1 WHEN id % 83 = 9 THEN 0 ELSE lft END AS lft,
         CASE WHEN id % 97 = 5 THEN lft WHEN id % 79 = 11 THEN rgt + 3 ELSE rgt END AS rgt,
         CASE WHEN id % 73 = 13 THEN depth + 1 ELSE depth END AS depth
  FROM t
)"""


def corrupt(select: str) -> str:
    """``select`` over c, the damaged heap."""
    return heap(f", {_CORRUPT}\n{select}").replace("USING (id))\n,", "USING (id)),")


def corrupt_rebuilt() -> str:
    """The damaged heap after repair: what hangs from a root is numbered by id."""
    whole = f""", {_CORRUPT}, r AS (
  SELECT id AS node, id AS anc, 0 AS dist FROM c
  UNION ALL SELECT r.node, p.parent_id, r.dist + 1 FROM r JOIN c AS p ON p.id = r.anc WHERE p.parent_id IS NOT NULL
), good AS (SELECT r.node FROM r JOIN c ON c.id = r.anc WHERE c.parent_id IS NULL),
g AS (SELECT r.* FROM r WHERE r.node IN (SELECT node FROM good)), {_placed('c', 'g', 'a.id', '2')}
SELECT c.id, c.parent_id, coalesce(p.lft, c.lft) AS lft, coalesce(p.rgt, c.rgt) AS rgt, CAST(coalesce(p.depth, c.depth) AS INTEGER) AS depth
FROM c LEFT JOIN place2 AS p ON p.id = c.id"""
    return heap(whole).replace("USING (id))\n,", "USING (id)),")


_P = "c JOIN c AS p ON p.id = c.parent_id"
CHECKS = {
    "invalid_bounds": "SELECT 'invalid_bounds' AS \"check\", count(*) AS n FROM c WHERE lft >= rgt",
    "duplicate_lft": "SELECT 'duplicate_lft' AS \"check\", count(*) AS n FROM (SELECT lft FROM c GROUP BY lft HAVING count(*) > 1)",
    "duplicate_rgt": "SELECT 'duplicate_rgt' AS \"check\", count(*) AS n FROM (SELECT rgt FROM c GROUP BY rgt HAVING count(*) > 1)",
    "orphans": "SELECT 'orphans' AS \"check\", count(*) AS n FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM c)",
    "parent_bounds_mismatch": f"SELECT 'parent_bounds_mismatch' AS \"check\", count(*) AS n FROM {_P} WHERE c.lft <= p.lft OR c.rgt >= p.rgt",
    "depth_mismatch": f"SELECT 'depth_mismatch' AS \"check\", (SELECT count(*) FROM c WHERE parent_id IS NULL AND depth <> 0) + (SELECT count(*) FROM {_P} WHERE c.depth <> p.depth + 1) AS n",
    "bounds_out_of_range": "SELECT 'bounds_out_of_range' AS \"check\", (SELECT count(*) FROM c WHERE (lft < 1 OR rgt < 1) AND NOT (lft = 0 AND rgt = 0)) + (SELECT count(*) FROM c AS a JOIN c AS b ON a.lft = b.rgt AND a.id <> b.id WHERE a.lft >= 1) AS n",
    "overlapping_bounds": "SELECT 'overlapping_bounds' AS \"check\", count(*) AS n FROM c AS a JOIN c AS b ON a.lft < b.lft AND b.lft < a.rgt AND a.rgt < b.rgt WHERE a.lft < a.rgt AND b.lft < b.rgt",
    "even_bounds_width": "SELECT 'even_bounds_width' AS \"check\", count(*) AS n FROM c WHERE lft < rgt AND (rgt - lft) % 2 = 0",
    "unreachable": "SELECT 'unreachable' AS \"check\", count(DISTINCT cl.node) AS n FROM cl JOIN c ON c.id = cl.anc WHERE c.parent_id NOT IN (SELECT id FROM c)",
}


def _scoped(rows: str, scope: str, select: str) -> str:
    """Chains: a node's place is its place in the order of its scope."""
    return f"""WITH n AS ({rows}), k AS (
  SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY ord) AS i, count(*) OVER (PARTITION BY {scope}) AS m FROM n
), t AS (SELECT *, id AS node, CAST(i AS BIGINT) AS lft, CAST(2 * m - i + 1 AS BIGINT) AS rgt, CAST(i - 1 AS INTEGER) AS depth FROM k),
cl AS (SELECT d.{scope}, d.id AS node, a.id AS anc, d.i - a.i AS dist FROM k AS d JOIN k AS a ON a.{scope} = d.{scope} AND a.i <= d.i)
{select}"""


def chain(select: str) -> str:
    return _scoped("SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, CAST(round(value * 100) AS BIGINT) AS cents FROM events", "user_id", select)


def conversations(select: str) -> str:
    return _scoped("SELECT conv_id, turn AS id, turn AS ord, role, CAST(length(text) AS BIGINT) AS length FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations)", "conv_id", select)


def diff(select: str) -> str:
    """``select`` over a (before) and b (after), each with its place among siblings."""
    return f"""WITH {_HEAP}, a AS (
  SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS place FROM h
), after AS (
  SELECT id, CASE WHEN id % 31 = 0 AND id > 0 THEN 0 ELSE parent_id END AS parent_id, CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END AS size
  FROM h WHERE NOT (id % 50 = 0 AND id NOT IN (SELECT parent_id FROM h WHERE parent_id IS NOT NULL))
  UNION ALL SELECT id + 50000000, id, size FROM h WHERE id BETWEEN 1 AND 5
), b AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS place FROM after)
{select}"""


JSON_NODES = """SELECT anc AS id, string_agg(
    CASE WHEN node <> anc AND NOT first THEN ',' ELSE '' END || '{"id":' || node || ',"label":"' || name || '","size":' || size || ',"children":['
    || repeat(']}', CAST(CASE WHEN following IS NULL THEN depth - top + 1 ELSE depth - following + 1 END AS INTEGER)), '' ORDER BY lft) AS node
FROM (
  SELECT cl.anc, cl.node, t.name, t.size, t.depth, t.lft, a.depth AS top, lead(t.depth) OVER (PARTITION BY cl.anc ORDER BY t.lft) AS following,
         t.lft = (SELECT min(s.lft) FROM t AS s WHERE s.parent_id = t.parent_id) AS first
  FROM cl JOIN t ON t.id = cl.node JOIN t AS a ON a.id = cl.anc
) GROUP BY anc"""

ASCII = """SELECT lft, coalesce(lead, '') || name || ' (depth ' || depth || ')' AS line FROM t LEFT JOIN (
  SELECT cl.node, string_agg(CASE WHEN cl.dist = 0 THEN CASE WHEN a.last THEN '└── ' ELSE '├── ' END ELSE CASE WHEN a.last THEN '    ' ELSE '│   ' END END, '' ORDER BY cl.dist DESC) AS lead
  FROM cl JOIN (SELECT id, depth, lft = max(lft) OVER (PARTITION BY parent_id) AS last FROM t) AS a ON a.id = cl.anc WHERE a.depth > 0 GROUP BY cl.node
) AS l ON l.node = t.id"""

GEO = """WITH o AS (
  SELECT 1000000000 + r_regionkey AS r, 2000000000 + n_nationkey AS n, 3000000000 + c_custkey AS c, 4000000000 + o_orderkey AS o, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
)
SELECT CAST(r AS BIGINT) AS id, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, count(cents) AS orders, 1 + count(DISTINCT n) + count(DISTINCT c) + count(o) AS nodes FROM o GROUP BY r
UNION ALL SELECT CAST(n AS BIGINT), CAST(coalesce(sum(cents), 0) AS BIGINT), count(cents), 1 + count(DISTINCT c) + count(o) FROM o WHERE n IS NOT NULL GROUP BY n
UNION ALL SELECT CAST(c AS BIGINT), CAST(coalesce(sum(cents), 0) AS BIGINT), count(cents), 1 + count(o) FROM o WHERE c IS NOT NULL GROUP BY c
UNION ALL SELECT CAST(o AS BIGINT), CAST(cents AS BIGINT), 1, 1 FROM o WHERE o IS NOT NULL"""
