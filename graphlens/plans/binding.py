"""A code graph over the star-schema tables, so that every operator can be run and checked on them.

The statements run in Spark and, as leading common table expressions, in any
SQL engine with the tables in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Graph
from .stages import stage

FILES_SQL = """
SELECT row_number() OVER (ORDER BY p_type, p_brand) AS id,
       concat(lower(p_type),
              CASE WHEN CAST(substring(p_brand, 7) AS INT) % 5 = 0 THEN '/tests/test_' ELSE '/' END,
              'b', substring(p_brand, 7),
              CASE WHEN CAST(substring(p_brand, 7) AS INT) % 2 = 0 THEN '.py' ELSE '.js' END) AS path,
       p_type, p_brand
FROM (SELECT DISTINCT p_type, p_brand FROM {part}) q"""

NODES_SQL = """
SELECT p.p_partkey AS id, f.id AS file_id,
       CASE WHEN p_size % 10 = 0 THEN 'class' WHEN p_size % 10 = 1 THEN 'module'
            WHEN p_size % 10 <= 5 THEN 'method' ELSE 'function' END AS type,
       replace(p_name, ' ', '_') AS name,
       concat('C', CAST(p_size AS STRING), '.', replace(p_name, ' ', '_')) AS qualified_name,
       CAST(10 * row_number() OVER (PARTITION BY f.id ORDER BY p_partkey) AS INT) AS start_line,
       CAST(10 * row_number() OVER (PARTITION BY f.id ORDER BY p_partkey) + p_size AS INT) AS end_line
FROM {part} p JOIN {cg_files} f ON f.p_type = p.p_type AND f.p_brand = p.p_brand"""

EDGES_SQL = """
SELECT source_id, target_id,
       CASE WHEN l_linestatus = 'F' THEN 'calls' WHEN l_discount < 0.08 THEN 'imports' ELSE 'inherits' END AS relation,
       CASE l_returnflag WHEN 'A' THEN 'extracted' WHEN 'N' THEN 'inferred' ELSE 'ambiguous' END AS confidence
FROM (SELECT l_partkey AS source_id,
             lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS target_id,
             l_linestatus, l_discount, l_returnflag, l_quantity FROM {lineitem}) q
WHERE target_id IS NOT NULL"""

#: Test code by path, as functions.expr.is_test_path has it.
IS_TEST_SQL = (
    "(regexp_matches(lower(path), '(^|/)(tests|test|__tests__|spec|specs)/') OR "
    "regexp_matches(lower(path), '(^|/)test_[^/]*$') OR regexp_matches(lower(path), '_tests?([.][^./]*)?$') OR "
    "regexp_matches(lower(path), '(^|/)(tests|test|conftest)([.][^./]*)?$') OR regexp_matches(lower(path), '[.](test|spec)[.][^/]*$'))"
)

#: What every oracle statement starts with.
CTES = (
    "WITH RECURSIVE cg_files AS (" + FILES_SQL.format(part="part") + "),\ncg_nodes AS ("
    + NODES_SQL.format(part="part", cg_files="cg_files") + "),\ncg_edges AS (" + EDGES_SQL.format(lineitem="lineitem")
    + "),\nsym AS (SELECT n.id, n.file_id, n.type, n.name, coalesce(n.qualified_name, n.name) AS qname, f.path, n.start_line, n.end_line, "
    + IS_TEST_SQL + " AS is_test FROM cg_nodes n JOIN cg_files f ON n.file_id = f.id)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_bound: dict[tuple[str, str, str], Graph] = {}


def bind(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables of a folder, built once a session: three tables beside its others."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), sf_dir)
    if key not in _bound:
        part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
        files = stage(spark.sql(FILES_SQL, part=part))
        nodes = stage(spark.sql(NODES_SQL, part=part, cg_files=files))
        edges = stage(spark.sql(EDGES_SQL, lineitem=lineitem))
        key = (key[0], spark.conf.get("spark.checkpoint.dir", ""), sf_dir)
        _bound[key] = Graph(files, nodes, edges)
    return _bound[key]
