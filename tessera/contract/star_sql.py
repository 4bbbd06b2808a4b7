"""The star graph in SQL, for oracles."""

NODES = """
nodes AS (
  SELECT 'region:' || CAST(r_regionkey AS BIGINT) AS id, r_name AS label, 'concept' AS file_type, 'geo/region.md' AS source_file, CAST(NULL AS BIGINT) AS community, CAST(r_regionkey AS BIGINT) AS node_ord FROM region
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS BIGINT), n_name, 'code', 'geo/r' || n_regionkey || '/nation.py', CAST(n_nationkey AS BIGINT), 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code', 'sales/n' || c_nationkey || '/customer.py', CAST(c_nationkey AS BIGINT), 2000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'supply/n' || s_nationkey || '/supplier.rs', CAST(s_nationkey AS BIGINT), 3000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'document', 'catalog/' || p_brand || '.md', CAST(p_partkey % 25 AS BIGINT), 4000000000000 + p_partkey FROM part
)"""

EDGES = """
edges AS (
  SELECT 'region:' || CAST(n_regionkey AS BIGINT) AS src, 'nation:' || CAST(n_nationkey AS BIGINT) AS tgt, 'contains' AS relation, 'EXTRACTED' AS confidence, 'geo/region.md' AS source_file, CAST(NULL AS VARCHAR) AS context FROM nation
  UNION ALL SELECT 'nation:' || CAST(c_nationkey AS BIGINT), 'customer:' || c_custkey, 'contains', 'EXTRACTED', 'geo/r' || n_regionkey || '/nation.py', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation:' || CAST(s_nationkey AS BIGINT), 'supplier:' || s_suppkey, 'contains', 'EXTRACTED', 'geo/r' || n_regionkey || '/nation.py', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls', CASE min(o_orderstatus) WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' WHEN 'P' THEN 'AMBIGUOUS' END, 'sales/n' || min(c_nationkey) || '/customer.py', 'invocation'
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 1 GROUP BY o_custkey, l_suppkey
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'uses', 'INFERRED', 'supply/n' || s_nationkey || '/supplier.rs', 'params'
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1
)"""

#: Degrees: an edge counts at both ends if both exist, a loop once.
DEGREES = """
known AS (SELECT e.* FROM edges e WHERE src IN (SELECT id FROM nodes) AND tgt IN (SELECT id FROM nodes)),
ends AS (SELECT src AS id FROM known UNION ALL SELECT tgt FROM known WHERE src <> tgt),
degrees AS (SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id)"""


def graph(sql: str, *more: str, degrees: bool = False, recursive: bool = False) -> str:
    """sql after the definitions of nodes and edges, of degrees if asked for, and of more tables."""
    parts = [NODES, EDGES, *([DEGREES] if degrees else []), *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(p.strip() for p in parts) + "\n" + sql.strip()
