"""The property graph over the driver's tables, and the same projection as SQL for the oracle.

Regions, nations, brands, customers, suppliers, parts and orders become symbols;
containment, calls, references, inheritance and imports follow from their keys.
Edge ids are computed from keys, not numbered, so no global order is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import active_edge
from graphloom.session import spread

LANGUAGES = ("typescript", "javascript", "python", "go", "java")


@dataclass
class Graph:
    """nodes, edges (all of them) and files; active holds the edges that queries may see."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def active(self) -> DataFrame:
        return self.edges.filter(active_edge())

    @property
    def files(self) -> DataFrame:
        return self.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"), F.min("language").alias("language"), F.sum(F.length("qualified_name")).cast("long").alias("size"))


def _node(df: DataFrame, kind: str, key: str, ident: Column, name: Column, qualified: Column, path: Column, language: Column, **more: Column) -> DataFrame:
    start = (F.col(key) % 1000 * 10 + 1).cast("int") if key else F.lit(1)
    null = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(kind + ":"), ident).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"), language.alias("language"),
        start.alias("start_line"), (start + 9).alias("end_line"), F.lit(0).alias("start_column"), F.length(name).cast("int").alias("end_column"),
        more.get("docstring", null).alias("docstring"), more.get("signature", null).alias("signature"), F.lit("public").alias("visibility"), more.get("is_exported", F.lit(True)).alias("is_exported"),
        F.lit(False).alias("is_async"), F.lit(False).alias("is_static"), F.lit(False).alias("is_abstract"), more.get("decorators", F.lit(None).cast("array<string>")).alias("decorators"),
        F.lit(None).cast("array<string>").alias("type_parameters"), null.alias("return_type"), F.lit(0).cast("long").alias("updated_at"),
    )


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def graph_projection(spark: SparkSession, sf_dir: str) -> Graph:
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation = table("region"), table("nation")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    language = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("r_regionkey") % 5 + 1).cast("int"))
    folder = F.concat_ws("/", "r_name", "n_name")
    customer = table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    part, orders, lineitem = table("part"), table("orders"), table("lineitem")
    customer_path = F.concat(folder, F.lit("/"), F.lower("c_mktsegment"), F.lit(".ts"))
    owned = orders.join(customer.select("c_custkey", "c_name", "r_regionkey", customer_path.alias("path")), F.col("o_custkey") == F.col("c_custkey"))
    cpp, order_name = F.lit("cpp"), F.concat(F.lit("order_"), _text("o_orderkey"))
    nodes = [
        _node(region, "module", "r_regionkey", _text("r_regionkey"), F.col("r_name"), F.col("r_name"), F.concat("r_name", F.lit("/mod.ts")), language),
        _node(places, "namespace", "n_nationkey", _text("n_nationkey"), F.col("n_name"), F.concat_ws(".", "r_name", "n_name"), F.concat(folder, F.lit("/mod.ts")), language),
        _node(part.select("p_brand").distinct(), "class", "", F.col("p_brand"), F.col("p_brand"), F.col("p_brand"), F.concat("p_brand", F.lit("/mod.cpp")), cpp),
        _node(customer, "class", "c_custkey", F.concat(F.lit("c"), _text("c_custkey")), F.col("c_name"), F.concat_ws(".", "n_name", "c_name"), customer_path, language, is_exported=F.col("c_acctbal") > 0),
        _node(supplier, "interface", "s_suppkey", _text("s_suppkey"), F.col("s_name"), F.concat_ws(".", "n_name", "s_name"), F.concat(folder, F.when(F.col("n_nationkey") % 3 == 0, "/tests").otherwise(""), F.lit("/suppliers.go")), language, is_exported=F.col("s_acctbal") > 0),
        _node(part, "function", "p_partkey", _text("p_partkey"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), (F.col("p_partkey") % 97).cast("string")), F.concat_ws("::", "p_brand", "p_name"), F.concat("p_brand", F.lit("/"), F.lower("p_type"), F.lit(".cpp")), cpp,
              docstring=F.col("p_name"), signature=F.concat(F.lower("p_type"), F.lit("(int "), _text("p_size"), F.lit(")")), is_exported=F.col("p_size") > 25, decorators=F.array("p_type")),
        _node(owned, "method", "o_orderkey", _text("o_orderkey"), order_name, F.concat_ws(".", F.col("c_name"), order_name), F.col("path"), language, docstring=F.col("o_orderpriority"), is_exported=F.col("o_orderstatus") == "O"),
    ]
    ids = lambda prefix, name: F.concat(F.lit(prefix), _text(name))

    def edge(df: DataFrame, number: Column, source: Column, target: Column, kind: str, metadata: Column | None = None, line: Column | None = None) -> DataFrame:
        return df.select(number.cast("long").alias("edge_id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"), (line if line is not None else F.lit(None)).cast("int").alias("line"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("provenance"))

    base = lambda k: F.lit(k * 10**15)
    before = orders.select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("earlier")).filter("earlier IS NOT NULL")
    chain = part.select("p_partkey", F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("parent")).filter("parent IS NOT NULL")
    siblings = nation.select("n_nationkey", F.lag("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("other")).filter("other IS NOT NULL")
    hidden = F.when(F.col("l_returnflag") == "R", F.lit('{"lsp":{"active":false}}'))
    edges = [
        edge(nation, base(1) + F.col("n_nationkey"), ids("module:", "n_regionkey"), ids("namespace:", "n_nationkey"), "contains"),
        edge(table("customer"), base(2) + F.col("c_custkey"), ids("namespace:", "c_nationkey"), ids("class:c", "c_custkey"), "contains"),
        edge(table("supplier"), base(3) + F.col("s_suppkey"), ids("namespace:", "s_nationkey"), ids("interface:", "s_suppkey"), "contains"),
        edge(orders, base(4) + F.col("o_orderkey"), ids("class:c", "o_custkey"), ids("method:", "o_orderkey"), "contains"),
        edge(part, base(5) + F.col("p_partkey"), ids("class:", "p_brand"), ids("function:", "p_partkey"), "contains"),
        edge(before, base(6) + F.col("o_orderkey"), ids("method:", "o_orderkey"), ids("method:", "earlier"), "calls"),
        edge(spread(lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "l_orderkey").dropDuplicates(["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]), base(7) + F.col("l_orderkey") * 10**7 + F.col("l_partkey") * 100 + F.col("l_linenumber") * 4 + F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2), ids("method:", "l_orderkey"), ids("function:", "l_partkey"), "calls", hidden, F.col("l_linenumber")),
        edge(spread(lineitem.select("l_partkey", "l_suppkey"), "l_partkey").distinct(), base(8) + F.col("l_partkey") * 10**6 + F.col("l_suppkey"), ids("function:", "l_partkey"), ids("interface:", "l_suppkey"), "references"),
        edge(chain, base(9) + F.col("p_partkey"), ids("function:", "p_partkey"), ids("function:", "parent"), "extends"),
        edge(siblings, base(10) + F.col("n_nationkey"), ids("namespace:", "n_nationkey"), ids("namespace:", "other"), "imports"),
    ]
    merge = lambda frames: __import__("functools").reduce(DataFrame.unionByName, frames)
    return Graph(merge(nodes), merge(edges))


#: The same projection for the oracle: common table expressions nodes, edges, active and files.
SQL = """WITH RECURSIVE places AS (SELECT *, list_extract(['typescript','javascript','python','go','java'], CAST(r_regionkey % 5 + 1 AS BIGINT)) AS lang FROM nation JOIN region ON n_regionkey = r_regionkey),
owned AS (SELECT o.*, c_name, lang, r_name || '/' || n_name || '/' || lower(c_mktsegment) || '.ts' AS path FROM orders o JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey),
raw_nodes AS (
SELECT 'module:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, r_name || '/mod.ts' AS file_path, list_extract(['typescript','javascript','python','go','java'], CAST(r_regionkey % 5 + 1 AS BIGINT)) AS language, r_regionkey % 1000 * 10 + 1 AS first_line, CAST(NULL AS VARCHAR) AS docstring, CAST(NULL AS VARCHAR) AS signature, TRUE AS is_exported, CAST(NULL AS VARCHAR[]) AS decorators FROM region
UNION ALL SELECT 'namespace:' || n_nationkey, 'namespace', n_name, r_name || '.' || n_name, r_name || '/' || n_name || '/mod.ts', lang, n_nationkey % 1000 * 10 + 1, NULL, NULL, TRUE, NULL FROM places
UNION ALL SELECT DISTINCT 'class:' || p_brand, 'class', p_brand, p_brand, p_brand || '/mod.cpp', 'cpp', 1, NULL, NULL, TRUE, NULL FROM part
UNION ALL SELECT 'class:c' || c_custkey, 'class', c_name, n_name || '.' || c_name, r_name || '/' || n_name || '/' || lower(c_mktsegment) || '.ts', lang, c_custkey % 1000 * 10 + 1, NULL, NULL, c_acctbal > 0, NULL FROM customer JOIN places ON c_nationkey = n_nationkey
UNION ALL SELECT 'interface:' || s_suppkey, 'interface', s_name, n_name || '.' || s_name, r_name || '/' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '/tests' ELSE '' END || '/suppliers.go', lang, s_suppkey % 1000 * 10 + 1, NULL, NULL, s_acctbal > 0, NULL FROM supplier JOIN places ON s_nationkey = n_nationkey
UNION ALL SELECT 'function:' || p_partkey, 'function', replace(p_name, ' ', '_') || '_' || (p_partkey % 97), p_brand || '::' || p_name, p_brand || '/' || lower(p_type) || '.cpp', 'cpp', p_partkey % 1000 * 10 + 1, p_name, lower(p_type) || '(int ' || p_size || ')', p_size > 25, [p_type] FROM part
UNION ALL SELECT 'method:' || o_orderkey, 'method', 'order_' || o_orderkey, c_name || '.order_' || o_orderkey, path, lang, o_orderkey % 1000 * 10 + 1, o_orderpriority, NULL, o_orderstatus = 'O', NULL FROM owned),
nodes AS (SELECT id, kind, name, qualified_name, file_path, language, CAST(first_line AS INTEGER) AS start_line, CAST(first_line + 9 AS INTEGER) AS end_line, 0 AS start_column, CAST(length(name) AS INTEGER) AS end_column, docstring, signature, is_exported, decorators FROM raw_nodes),
edges AS (
SELECT CAST(1000000000000000 + n_nationkey AS BIGINT) AS edge_id, 'module:' || n_regionkey AS source, 'namespace:' || n_nationkey AS target, 'contains' AS kind, CAST(NULL AS VARCHAR) AS metadata, CAST(NULL AS INTEGER) AS line FROM nation
UNION ALL SELECT 2000000000000000 + c_custkey, 'namespace:' || c_nationkey, 'class:c' || c_custkey, 'contains', NULL, NULL FROM customer
UNION ALL SELECT 3000000000000000 + s_suppkey, 'namespace:' || s_nationkey, 'interface:' || s_suppkey, 'contains', NULL, NULL FROM supplier
UNION ALL SELECT 4000000000000000 + o_orderkey, 'class:c' || o_custkey, 'method:' || o_orderkey, 'contains', NULL, NULL FROM orders
UNION ALL SELECT 5000000000000000 + p_partkey, 'class:' || p_brand, 'function:' || p_partkey, 'contains', NULL, NULL FROM part
UNION ALL SELECT 6000000000000000 + o_orderkey, 'method:' || o_orderkey, 'method:' || earlier, 'calls', NULL, NULL FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier FROM orders) WHERE earlier IS NOT NULL
UNION ALL SELECT 7000000000000000 + l_orderkey * 10000000 + l_partkey * 100 + l_linenumber * 4 + CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, 'method:' || l_orderkey, 'function:' || l_partkey, 'calls', CASE WHEN l_returnflag = 'R' THEN '{"lsp":{"active":false}}' END, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem)
UNION ALL SELECT 8000000000000000 + l_partkey * 1000000 + l_suppkey, 'function:' || l_partkey, 'interface:' || l_suppkey, 'references', NULL, NULL FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 9000000000000000 + p_partkey, 'function:' || p_partkey, 'function:' || parent, 'extends', NULL, NULL FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS parent FROM part) WHERE parent IS NOT NULL
UNION ALL SELECT 10000000000000000 + n_nationkey, 'namespace:' || n_nationkey, 'namespace:' || other, 'imports', NULL, NULL FROM (SELECT n_nationkey, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS other FROM nation) WHERE other IS NOT NULL),
active AS (SELECT * FROM edges WHERE coalesce(json_extract_string(metadata, '$.lsp.active') NOT IN ('false', '0'), TRUE)),
files AS (SELECT file_path AS path, CAST(count(*) AS INTEGER) AS node_count, min(language) AS language, CAST(sum(length(qualified_name)) AS BIGINT) AS size FROM nodes GROUP BY file_path)
"""
