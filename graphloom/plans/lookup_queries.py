"""Lookups, joins, aggregates, rankings and set operations over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import EMBEDDABLE_KINDS, RENAME_KINDS, folder, is_generated_file, is_low_value_file, is_test_file, language_family, path_glob_regex
from graphloom.operators import lookups, store
from graphloom.operators.catalogs import cluster_overlaps, file_graph, file_pair_weights
from graphloom.operators.changes import changed_files, head_equivalents, intersecting_symbols, parse_unified_diff
from graphloom.operators.traversal import bounded_adjacency, file_dependencies, first_edges
from graphloom.plans.registry import query

IN = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"
CLASS, BRAND, NATION = "class:c7", "class:Brand#1", "namespace:3"
LOW_SQL = "regexp_matches(lower({0}), '(^|/)(tests?|__tests?__|spec)/')"
TEST_SQL = "regexp_matches(lower({0}), '/(tests?|__tests__|specs?|testlib|testing)/|^(tests?|specs?)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/')"


@query("flt_01", "SELECT id, kind, name, file_path FROM nodes WHERE id = 'class:c7'")
def _(g, spark, sf):
    return lookups.nodes_by_ids(g.nodes, [CLASS]).select("id", "kind", "name", "file_path")


@query("flt_02", "SELECT n.id, name FROM nodes n JOIN (SELECT 'method:' || o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0) w ON w.id = n.id")
def _(g, spark, sf):
    wanted = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("id"))
    return g.nodes.join(wanted, "id", "left_semi").select("id", "name")


@query("flt_03", "SELECT id, start_line, end_line FROM nodes WHERE file_path = (SELECT file_path FROM nodes WHERE id = 'class:c7')")
def _(g, spark, sf):
    path = g.nodes.filter(F.col("id") == CLASS).select("file_path")
    return g.nodes.join(path, "file_path", "left_semi").orderBy("start_line", "id").select("id", "start_line", "end_line")


@query("flt_04", "SELECT id, 'prefix' AS rule FROM (SELECT id FROM nodes WHERE name >= 'order_1' AND name < 'order_2' ORDER BY name, id LIMIT 20) UNION ALL SELECT id, 'lower' FROM nodes WHERE lower(name) = 'nation_3' UNION ALL SELECT id, 'qualified' FROM nodes WHERE qualified_name = 'AMERICA.NATION_1'")
def _(g, spark, sf):
    prefix = g.nodes.filter(F.col("name").startswith("order_1")).orderBy("name", "id").limit(20).select("id", F.lit("prefix").alias("rule"))
    lower = g.nodes.filter(F.lower("name") == "nation_3").select("id", F.lit("lower").alias("rule"))
    return prefix.unionByName(lower).unionByName(g.nodes.filter("qualified_name = 'AMERICA.NATION_1'").select("id", F.lit("qualified").alias("rule")))


@query("flt_05", "SELECT id, name FROM nodes WHERE contains(lower(name), 'ring') ORDER BY length(name), id LIMIT 30")
def _(g, spark, sf):
    return lookups.name_substring(g.nodes, "RING").select("id", "name")


@query("flt_06", """, h AS (SELECT *, lower(name) AS low FROM nodes WHERE lower(name) IN ('nation_3', 'brand#1', 'order_7', 'red_widget_1')),
d AS (SELECT DISTINCT file_path FROM h WHERE low IN (SELECT low FROM h GROUP BY low HAVING count(DISTINCT file_path) < 10)),
s AS (SELECT id, low, 1.0 + CASE WHEN file_path IN (SELECT file_path FROM d) THEN 20.0 ELSE 0.0 END AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY score DESC, id) AS nth FROM s)
SELECT id, CAST(score AS DOUBLE) AS score FROM r WHERE nth <= 13 ORDER BY score DESC, id LIMIT 50""")
def _(g, spark, sf):
    return lookups.exact_names(g.nodes, ["NATION_3", "Brand#1", "order_7", "red_widget_1"]).select("id", F.col("score").cast("double").alias("score"))


@query("flt_07", "SELECT id, name FROM nodes WHERE kind = 'function' AND language = 'cpp' ORDER BY name, id LIMIT 100")
def _(g, spark, sf):
    return g.nodes.filter("kind = 'function' AND language = 'cpp'").orderBy("name", "id").limit(100).select("id", "name")


@query("flt_08", "SELECT id FROM nodes WHERE (contains(lower(file_path), 'asia') OR contains(lower(file_path), 'brand#2')) AND (contains(lower(name), 'supplier') OR contains(lower(name), 'red'))")
def _(g, spark, sf):
    return lookups.gate(g.nodes, ["ASIA", "Brand#2"], ["supplier", "red"]).select("id")


@query("flt_09", "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM active GROUP BY kind")
def _(g, spark, sf):
    return g.active.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("flt_10", "SELECT id FROM nodes WHERE kind IN ('class','function','method','interface','type_alias','variable','constant') AND regexp_full_match(qualified_name, 'NATION_.\\.Cust.*1')")
def _(g, spark, sf):
    return lookups.by_qualified_glob(g.nodes, "NATION_?.Cust*1").select("id")


@query("flt_11", "SELECT path, node_count FROM files WHERE regexp_matches(path, 'NATION_./[^/]*\\.ts') AND starts_with(path, 'ASIA/')")
def _(g, spark, sf):
    return g.files.filter(F.col("path").rlike(path_glob_regex("NATION_?/*.ts")) & F.col("path").startswith("ASIA/")).select("path", "node_count")


@query("flt_12", f"SELECT path, {TEST_SQL.format('path')} AS is_test, {LOW_SQL.format('path')} AS is_low_value, FALSE AS is_generated FROM files")
def _(g, spark, sf):
    p = F.col("path")
    return g.files.select("path", is_test_file(p).alias("is_test"), is_low_value_file(p).alias("is_low_value"), is_generated_file(p).alias("is_generated"))


@query("flt_13", "SELECT id, CAST(row_number() OVER (ORDER BY end_line - start_line, end_column - start_column, length(name) DESC, id) AS INTEGER) AS place FROM nodes WHERE file_path = (SELECT file_path FROM nodes WHERE id = 'class:c7') AND start_line <= 75 AND end_line >= 75")
def _(g, spark, sf):
    """What covers a line, the narrowest first."""
    path = g.nodes.filter(F.col("id") == CLASS).first()["file_path"]
    found = lookups.at_location(g.nodes, path, 75)
    order = Window.orderBy(F.col("end_line") - F.col("start_line"), F.col("end_column") - F.col("start_column"), F.desc(F.length("name")), "id")  # over the nodes of one line
    return found.select("id", F.row_number().over(order).cast("int").alias("place"))


@query("flt_14", "SELECT id FROM nodes WHERE file_path LIKE 'Brand#1/%' AND is_exported")
def _(g, spark, sf):
    return g.nodes.filter(F.col("file_path").startswith("Brand#1/") & F.col("is_exported")).select("id")


@query("flt_15", "SELECT edge_id, source, target, kind FROM active WHERE source = 'function:5' UNION SELECT edge_id, source, target, kind FROM active WHERE target = 'function:5' AND kind IN ('calls', 'contains')")
def _(g, spark, sf):
    return g.active.filter("source = 'function:5' OR (target = 'function:5' AND kind IN ('calls', 'contains'))").select("edge_id", "source", "target", "kind")


@query("flt_16", ", w AS (SELECT id FROM nodes WHERE kind IN ('function', 'interface') AND start_line < 3000) SELECT edge_id, kind FROM active WHERE source IN (SELECT id FROM w) AND target IN (SELECT id FROM w) AND kind IN ('references', 'extends')")
def _(g, spark, sf):
    ids = g.nodes.filter("kind IN ('function', 'interface') AND start_line < 3000").select("id")
    return lookups.edges_between(g.active, ids, ("references", "extends")).select("edge_id", "kind")


@query("flt_17", "SELECT edge_id, kind FROM active WHERE source = 'function:5' OR target = 'function:5' ORDER BY CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END, edge_id LIMIT 15")
def _(g, spark, sf):
    return bounded_adjacency(g.active, "function:5", "both", 15).select("edge_id", "kind")


@query("flt_18", "SELECT edge_id, kind FROM active WHERE target = 'interface:3' AND kind <> 'contains' AND (kind > 'references' OR (kind = 'references' AND edge_id > 8000000020000003)) ORDER BY kind, edge_id LIMIT 11")
def _(g, spark, sf):
    return lookups.incoming_page(g.active, "interface:3", ("references", 8000000020000003), 10).select("edge_id", "kind")


@query("flt_20", "SELECT source, line, any_value(target) AS target FROM active WHERE kind = 'calls' AND line IS NOT NULL GROUP BY source, line HAVING count(*) = 1")
def _(g, spark, sf):
    return lookups.unique_at(g.active.filter("kind = 'calls' AND line IS NOT NULL"), ["source", "line"]).select("source", "line", "target")


@query("flt_21", "SELECT path FROM files WHERE node_count % 3 = 0")
def _(g, spark, sf):
    stored = g.files.select("path", F.lit("a").alias("content_hash"))
    seen = g.files.select("path", F.when(F.col("node_count") % 3 == 0, "b").otherwise("a").alias("content_hash"))
    return lookups.stale_files(stored, seen)


@query("flt_24", ", f AS (SELECT edge_id, regexp_extract(qualified_name, '[^.:]*$', 0) AS name_tail FROM edges e JOIN nodes n ON e.target = n.id WHERE e.kind IN ('calls', 'extends')) SELECT edge_id AS ref_id, name_tail FROM f WHERE name_tail IN (SELECT name FROM nodes) AND name_tail IN (SELECT name_tail FROM f GROUP BY name_tail HAVING count(*) <= 3)")
def _(g, spark, sf):
    failed = g.edges.filter("kind IN ('calls', 'extends')").join(g.nodes.select(F.col("id").alias("target"), lookups.name_tail(F.col("qualified_name")).alias("name_tail")), "target").select(F.col("edge_id").alias("ref_id"), "name_tail")
    return lookups.retryable(failed, g.nodes.select("name"), 3)


@query("flt_25", ", w AS (SELECT id FROM nodes WHERE kind = 'function' AND is_exported AND start_line % 3 = 0) SELECT edge_id FROM active WHERE source IN (SELECT id FROM w) AND target IN (SELECT id FROM w)")
def _(g, spark, sf):
    return lookups.edges_between(g.active, g.nodes.filter("kind = 'function' AND is_exported AND start_line % 3 = 0")).select("edge_id")


@query("flt_26", "SELECT target, edge_id FROM (SELECT target, edge_id, row_number() OVER (PARTITION BY target ORDER BY edge_id) AS nth FROM active WHERE kind <> 'contains') WHERE nth <= 3")
def _(g, spark, sf):
    return first_edges(g.active.filter("kind <> 'contains'"), "target", 3).select("target", "edge_id")


@query("flt_27", "SELECT DISTINCT 'function:' || l_partkey AS id FROM lineitem WHERE l_quantity > 45 AND 'function:' || l_partkey IN (SELECT id FROM nodes)")
def _(g, spark, sf):
    asked = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 45").select(F.concat(F.lit("function:"), F.col("l_partkey").cast("string")).alias("id"))
    return g.nodes.select("id").join(asked, "id", "left_semi")


PAIRS_SQL = ", deps AS (SELECT DISTINCT s.file_path AS source_file, t.file_path AS target_file FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind <> 'contains' AND s.file_path <> t.file_path)"


@query("join_01", PAIRS_SQL + " SELECT source_file AS path FROM deps WHERE target_file = 'Brand#1/economy.cpp'")
def _(g, spark, sf):
    return file_dependencies(g.nodes, g.active).filter("target_file = 'Brand#1/economy.cpp'").select(F.col("source_file").alias("path"))


@query("join_02", PAIRS_SQL + " SELECT target_file AS path FROM deps WHERE source_file = 'Brand#1/economy.cpp'")
def _(g, spark, sf):
    return file_dependencies(g.nodes, g.active).filter("source_file = 'Brand#1/economy.cpp'").select(F.col("target_file").alias("path"))


@query("join_03", "SELECT e.edge_id, t.name AS target_name, t.kind AS target_kind, s.file_path AS source_file, s.language AS source_language FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE t.file_path = 'Brand#1/economy.cpp' AND s.file_path <> t.file_path")
def _(g, spark, sf):
    targets = g.nodes.filter("file_path = 'Brand#1/economy.cpp'").select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), "file_path")
    sources = g.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"), F.col("language").alias("source_language"))
    return g.active.join(targets, "target").join(sources, "source").filter("source_file <> file_path").select("edge_id", "target_name", "target_kind", "source_file", "source_language")


@query("join_04", f", m AS (SELECT s.name AS url, t.name AS handler, t.file_path AS handler_file, t.start_line AS handler_line, t.kind AS handler_kind, row_number() OVER (ORDER BY s.file_path, s.start_line, s.id, e.edge_id) AS nth FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE s.kind = 'method' AND e.kind IN ('calls', 'references') AND t.kind IN ('function', 'method', 'class') QUALIFY nth <= 40), k AS (SELECT *, count(*) OVER (PARTITION BY handler_file) AS in_file, count(*) OVER () AS total FROM m WHERE NOT {LOW_SQL.format('handler_file')}) SELECT url, handler, handler_file, handler_line, handler_kind, CAST(in_file AS BIGINT) AS in_file, handler_file = first_value(handler_file) OVER (ORDER BY in_file DESC, nth) AS top_file FROM k WHERE total >= 3")
def _(g, spark, sf):
    """Methods stand for routes, which the tables do not have."""
    return lookups.routing_manifest(g.nodes, g.active, "method")


@query("join_05", f"SELECT e.edge_id, e.kind, s.file_path FROM active e JOIN nodes s ON e.source = s.id WHERE e.target = 'function:5' AND e.kind IN {IN(RENAME_KINDS)}")
def _(g, spark, sf):
    return g.active.filter((F.col("target") == "function:5") & F.col("kind").isin(*RENAME_KINDS)).join(g.nodes.select(F.col("id").alias("source"), "file_path"), "source").select("edge_id", "kind", "file_path")


@query("join_06", "SELECT s.file_path, CAST(count(*) AS BIGINT) AS candidates FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind IN ('calls','references','imports','instantiates') AND e.line IS NOT NULL AND s.language IN ('python', 'go') GROUP BY s.file_path")
def _(g, spark, sf):
    sources = g.nodes.filter("language IN ('python', 'go')").select(F.col("id").alias("source"), "file_path")
    rows = g.active.filter("kind IN ('calls','references','imports','instantiates') AND line IS NOT NULL").join(sources, "source").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("candidates"))


VECTORS_SQL = ", vectors AS (SELECT 'function:' || vec_id AS id, label FROM embeddings)"


def node_vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.concat(F.lit("function:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), "label")


@query("join_07", VECTORS_SQL + f" SELECT id FROM nodes WHERE kind IN {IN(EMBEDDABLE_KINDS)} AND kind <> 'method' AND id NOT IN (SELECT id FROM vectors)")
def _(g, spark, sf):
    return g.nodes.filter(F.col("kind").isin(*EMBEDDABLE_KINDS) & (F.col("kind") != "method")).select("id").join(node_vectors(spark, sf).select("id"), "id", "left_anti")


@query("join_08", VECTORS_SQL + f" SELECT v.id, n.kind, v.label FROM vectors v JOIN nodes n ON v.id = n.id WHERE n.kind IN {IN(EMBEDDABLE_KINDS)}")
def _(g, spark, sf):
    return node_vectors(spark, sf).select("id", "label").join(g.nodes.filter(F.col("kind").isin(*EMBEDDABLE_KINDS)).select("id", "kind"), "id").select("id", "kind", "label")


@query("join_09", VECTORS_SQL + " SELECT id FROM vectors WHERE id IN (SELECT id FROM nodes WHERE start_line % 7 <> 0)")
def _(g, spark, sf):
    return node_vectors(spark, sf).select("id").join(g.nodes.filter("start_line % 7 <> 0").select("id"), "id", "left_semi")


@query("join_10", "SELECT c.id AS flow_id, e.target AS node_id, s.name AS symbol_name FROM nodes c LEFT JOIN edges e ON e.source = c.id AND e.kind = 'contains' LEFT JOIN nodes s ON s.id = e.target WHERE c.kind = 'class'")
def _(g, spark, sf):
    flows = g.nodes.filter("kind = 'class'").select(F.col("id").alias("flow_id"))
    steps = g.edges.filter("kind = 'contains'").select(F.col("source").alias("flow_id"), F.col("target").alias("node_id"))
    return flows.join(steps, "flow_id", "left").join(g.nodes.select(F.col("id").alias("node_id"), F.col("name").alias("symbol_name")), "node_id", "left").select("flow_id", "node_id", "symbol_name")


@query("join_11", "SELECT f.language AS cluster_id, CAST(count(f.path) AS BIGINT) AS members, min(f.path) AS first_path, max(f.path) AS last_path FROM files f GROUP BY f.language")
def _(g, spark, sf):
    clusters = g.files.select(F.col("language").alias("cluster_id")).distinct()
    return clusters.join(g.files.select(F.col("language").alias("cluster_id"), "path"), "cluster_id", "left").groupBy("cluster_id").agg(F.count("path").alias("members"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


HUNKS_SQL = ", hunks AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS hunk_id, n.file_path AS path, CAST(l_orderkey % 500 * 15 + 1 AS INTEGER) AS a, CAST(l_orderkey % 500 * 15 + 1 + l_quantity AS INTEGER) AS b FROM (SELECT l_orderkey, l_partkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) JOIN nodes n ON n.id = 'function:' || l_partkey)"


def hunks(g, spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    start = (F.col("l_orderkey") % 500 * 15 + 1).cast("int")
    rows = line.select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hunk_id"), F.concat(F.lit("function:"), F.col("l_partkey").cast("string")).alias("id"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"))
    return rows.join(g.nodes.select("id", F.col("file_path").alias("path")), "id").select("hunk_id", "path", "start", "end")


@query("join_12", HUNKS_SQL + " SELECT hunk_id, id FROM hunks JOIN nodes ON file_path = path AND start_line <= b AND end_line >= a AND kind IN ('class', 'interface', 'function', 'method')")
def _(g, spark, sf):
    return intersecting_symbols(hunks(g, spark, sf), g.nodes)


@query("join_13", "SELECT id, CASE WHEN start_line % 4 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM nodes WHERE kind = 'method'")
def _(g, spark, sf):
    base = g.nodes.filter("kind = 'method'")
    return head_equivalents(base, base.filter("start_line % 4 <> 1"))


@query("join_15", ", last AS (SELECT kind, name, max_by('new:' || id, struct_pack(start_line, id)) AS new_target FROM nodes WHERE start_line % 4 <> 1 GROUP BY kind, name) SELECT e.edge_id, l.new_target AS target FROM active e JOIN nodes t ON e.target = t.id LEFT JOIN last l ON l.kind = t.kind AND l.name = t.name WHERE e.kind = 'calls'")
def _(g, spark, sf):
    from graphloom.operators.resolve import reattach

    new = g.nodes.filter("start_line % 4 <> 1")
    moved, lost = reattach(g.active.filter("kind = 'calls'"), g.nodes, new)
    return moved.select("edge_id", F.concat(F.lit("new:"), "target").alias("target")).unionByName(lost.select("edge_id", F.lit(None).cast("string").alias("target")))


@query("agg_01", "SELECT 'node:' || kind AS what, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge:' || kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'file:' || language, count(*) FROM files GROUP BY language")
def _(g, spark, sf):
    part = lambda df, tag, c: df.groupBy(F.concat(F.lit(tag), c).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return part(g.nodes, "node:", F.col("kind")).unionByName(part(g.edges, "edge:", F.col("kind"))).unionByName(part(g.files, "file:", F.col("language")))


IN_FILE_SQL = f", c AS (SELECT s.file_path, count(*) AS n FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE s.file_path = t.file_path GROUP BY s.file_path), top AS (SELECT * FROM (SELECT * FROM c ORDER BY n DESC, file_path LIMIT 20) WHERE NOT {LOW_SQL.format('file_path')})"


@query("agg_02", IN_FILE_SQL + " SELECT file_path, edge_count, next_edge_count FROM (SELECT file_path, CAST(n AS BIGINT) AS edge_count, CAST(coalesce(lead(n) OVER (ORDER BY n DESC, file_path), 0) AS BIGINT) AS next_edge_count, row_number() OVER (ORDER BY n DESC, file_path) AS nth FROM top) WHERE nth = 1 AND edge_count >= 20")
def _(g, spark, sf):
    return lookups.dominant_file(g.nodes, g.active)


@query("agg_03", f", c AS (SELECT file_path, count(*) AS n FROM nodes WHERE kind = 'method' GROUP BY file_path ORDER BY n DESC, file_path LIMIT 20), k AS (SELECT *, sum(n) OVER () AS total FROM c WHERE NOT {LOW_SQL.format('file_path')}) SELECT file_path, CAST(n AS BIGINT) AS routes, CAST(total AS BIGINT) AS total FROM k WHERE n >= 3 AND total >= 3 AND n >= 0.01 * total QUALIFY row_number() OVER (ORDER BY n DESC, file_path) = 1")
def _(g, spark, sf):
    """Methods stand for routes, which the tables do not have; so many files have them that a hundredth is asked for."""
    return lookups.top_route_file(g.nodes, "method", share=0.01)


WEIGHTS_SQL = ", w AS (SELECT s.file_path AS source_file, t.file_path AS target_file, count(*) AS weight FROM active e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind IN ('calls', 'imports') AND s.file_path <> t.file_path GROUP BY 1, 2)"


@query("agg_04", WEIGHTS_SQL + " SELECT source_file, target_file, CAST(weight AS BIGINT) AS weight FROM w")
def _(g, spark, sf):
    return file_pair_weights(g.nodes, g.active)


@query("agg_05", WEIGHTS_SQL + " SELECT least(source_file, target_file) AS a, greatest(source_file, target_file) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY 1, 2")
def _(g, spark, sf):
    return file_graph(file_pair_weights(g.nodes, g.active))


@query("agg_08", "SELECT language, CAST(max(edge_id) AS BIGINT) AS last_id FROM active JOIN nodes ON source = id GROUP BY language")
def _(g, spark, sf):
    return g.active.join(g.nodes.select(F.col("id").alias("source"), "language"), "source").groupBy("language").agg(F.max("edge_id").alias("last_id"))


@query("agg_09", VECTORS_SQL + f" SELECT CAST((SELECT count(*) FROM nodes WHERE kind IN {IN(EMBEDDABLE_KINDS)}) AS BIGINT) AS embeddable, CAST((SELECT count(*) FROM nodes WHERE kind IN {IN(EMBEDDABLE_KINDS)} AND id IN (SELECT id FROM vectors)) AS BIGINT) AS embedded")
def _(g, spark, sf):
    rows = g.nodes.filter(F.col("kind").isin(*EMBEDDABLE_KINDS)).select("id").join(node_vectors(spark, sf).select("id", F.lit(1).alias("v")), "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("embeddable"), F.count("v").alias("embedded"))


@query("agg_10", "SELECT c.id AS flow_id, CAST(coalesce(k.n, 0) AS BIGINT) AS steps FROM nodes c LEFT JOIN (SELECT source, count(*) AS n FROM edges WHERE kind = 'contains' GROUP BY source) k ON k.source = c.id WHERE c.kind = 'class' ORDER BY c.id LIMIT 50 OFFSET 10")
def _(g, spark, sf):
    counts = g.edges.filter("kind = 'contains'").groupBy(F.col("source").alias("flow_id")).agg(F.count(F.lit(1)).alias("steps"))
    page = g.nodes.filter("kind = 'class'").select(F.col("id").alias("flow_id")).orderBy("flow_id").offset(10).limit(50)
    return page.join(counts, "flow_id", "left").na.fill({"steps": 0})


@query("agg_11", "SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM edges) AS BIGINT) AS edges, CAST((SELECT count(*) FROM files) AS BIGINT) AS files, CAST((SELECT max(edge_id) FROM edges) AS BIGINT) AS last_edge")
def _(g, spark, sf):
    return lookups.totals(g.nodes, g.edges).select("nodes", "edges", "files", "last_edge")


@query("agg_12", "SELECT file_path, qualified_name, CAST(count(*) AS BIGINT) AS definitions, min(id) AS first_id FROM nodes WHERE kind = 'function' GROUP BY file_path, qualified_name")
def _(g, spark, sf):
    return g.nodes.filter("kind = 'function'").groupBy("file_path", "qualified_name").agg(F.count(F.lit(1)).alias("definitions"), F.min("id").alias("first_id"))


@query("agg_14", "SELECT prefix, CAST(count(*) AS BIGINT) AS files, CAST(sum(node_count) AS BIGINT) AS nodes FROM (SELECT array_to_string(list_slice(string_split(path, '/'), 1, d), '/') AS prefix, node_count FROM files, range(1, 4) t(d) WHERE d < len(string_split(path, '/'))) GROUP BY prefix")
def _(g, spark, sf):
    parts = F.split("path", "/")
    rows = g.files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("prefix"), "node_count")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("files"), F.sum("node_count").cast("long").alias("nodes"))


@query("win_01", "SELECT file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'method' THEN 1 ELSE 2 END, id) AS nth FROM nodes) WHERE nth <= 5")
def _(g, spark, sf):
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "method", 1).otherwise(2)
    return g.nodes.select("file_path", "id", F.row_number().over(Window.partitionBy("file_path").orderBy(rank, "id")).alias("nth")).filter("nth <= 5").drop("nth")


@query("win_02", f"SELECT id FROM (SELECT id, {TEST_SQL.format('file_path')} AS t, row_number() OVER (PARTITION BY {TEST_SQL.format('file_path')} ORDER BY id) AS nth FROM nodes WHERE kind = 'interface') WHERE NOT t OR nth <= 3")
def _(g, spark, sf):
    rows = g.nodes.filter("kind = 'interface'").withColumn("t", is_test_file(F.col("file_path")))
    return rows.select("id", "t", F.row_number().over(Window.partitionBy("t").orderBy("id")).alias("nth")).filter("NOT t OR nth <= 3").select("id")


@query("win_04", IN_FILE_SQL + " SELECT file_path, CAST(n AS BIGINT) AS n, coalesce(n >= 3 * lead(n) OVER (ORDER BY n DESC, file_path), FALSE) AS dominant FROM top")
def _(g, spark, sf):
    return lookups.inner_edge_counts(g.nodes, g.active).withColumnRenamed("edge_count", "n").select("file_path", "n", F.coalesce(F.col("n") >= 3 * F.lead("n").over(Window.orderBy(F.desc("n"), "file_path")), F.lit(False)).alias("dominant"))


@query("win_06", "SELECT CAST(1 AS BIGINT) AS diff_id, 'a.py' AS new_path, 3 AS old_start, 2 AS old_lines, 3 AS new_start, 1 AS new_lines UNION ALL SELECT 1, 'a.py', 10, 1, 9, 4 UNION ALL SELECT 1, NULL, 1, 7, 0, 0")
def _(g, spark, sf):
    text = ["diff --git a/a.py b/a.py", "--- a/a.py", "+++ b/a.py", "@@ -3,2 +3 @@ def f", "-x", "@@ -10 +9,4 @@", "+y", "--- a/b.py", "+++ /dev/null", "@@ -1,7 +0,0 @@"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "diff_id long, line_no int, line string")
    return parse_unified_diff(lines).select("diff_id", "new_path", "old_start", "old_lines", "new_start", "new_lines")


@query("win_07", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(g, spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("top_02", "SELECT id, CAST(count(*) OVER () AS BIGINT) AS total FROM nodes WHERE kind = 'class' ORDER BY id LIMIT 25 OFFSET 50")
def _(g, spark, sf):
    rows = g.nodes.filter("kind = 'class'").select("id")
    total = rows.count()
    return rows.orderBy("id").offset(50).limit(25).withColumn("total", F.lit(total).cast("long"))


@query("top_04", "SELECT id, qualified_name FROM nodes WHERE kind IN ('function', 'interface') ORDER BY qualified_name, file_path, start_line, id LIMIT 200")
def _(g, spark, sf):
    return g.nodes.filter("kind IN ('function', 'interface')").orderBy("qualified_name", "file_path", "start_line", "id").limit(200).select("id", "qualified_name")


@query("top_07", f"SELECT path FROM files ORDER BY {LOW_SQL.format('path')}, node_count DESC, path LIMIT 60")
def _(g, spark, sf):
    return g.files.orderBy(is_low_value_file(F.col("path")), F.desc("node_count"), "path").limit(60).select("path")


@query("set_01", "SELECT id, max(score) AS score FROM (SELECT id, CAST(1.0 AS DOUBLE) AS score FROM nodes WHERE kind = 'interface' UNION ALL SELECT id, CAST(start_line % 5 AS DOUBLE) FROM nodes WHERE kind IN ('interface', 'namespace')) GROUP BY id")
def _(g, spark, sf):
    a = g.nodes.filter("kind = 'interface'").select("id", F.lit(1.0).alias("score"))
    b = g.nodes.filter("kind IN ('interface', 'namespace')").select("id", (F.col("start_line") % 5).cast("double").alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.max("score").alias("score"))


@query("set_04", "SELECT path, CASE WHEN node_count % 4 = 0 THEN 'removed' WHEN node_count % 4 = 1 THEN 'added' ELSE 'modified' END AS change FROM files WHERE node_count % 4 <> 3")
def _(g, spark, sf):
    old = g.files.filter("node_count % 4 <> 1").select("path", F.lit("x").alias("content_hash"))
    new = g.files.filter("node_count % 4 <> 0").select("path", F.when(F.col("node_count") % 4 == 3, "x").otherwise("y").alias("content_hash"))
    return changed_files(old, new)


@query("set_05", ", o AS (SELECT language AS c, path FROM files), n AS (SELECT CAST(node_count % 3 AS VARCHAR) AS c, path FROM files), b AS (SELECT o.c AS old_id, n.c AS new_id, count(*) AS k FROM o JOIN n USING (path) GROUP BY 1, 2) SELECT old_id, new_id, round(k * 1.0 / ((SELECT count(*) FROM o WHERE c = old_id) + (SELECT count(*) FROM n WHERE c = new_id) - k), 6) AS jaccard FROM b")
def _(g, spark, sf):
    old, new = g.files.select(F.col("language").alias("cluster_id"), "path"), g.files.select((F.col("node_count") % 3).cast("string").alias("cluster_id"), "path")
    return cluster_overlaps(old, new).withColumn("jaccard", F.round("jaccard", 6))


@query("snk_03", "SELECT edge_id, target, kind FROM edges WHERE source IN (SELECT id FROM nodes WHERE start_line % 2 = 0 OR kind <> 'method') AND target IN (SELECT id FROM nodes WHERE start_line % 2 = 0 OR kind <> 'method')")
def _(g, spark, sf):
    gone = g.nodes.filter("kind = 'method' AND start_line % 2 <> 0").select("id")
    return store.cascade(g.edges, store.delete(g.nodes, gone, ["id"])).select("edge_id", "target", "kind")


@query("snk_04", "SELECT edge_id, CASE WHEN edge_id % 3 = 0 THEN 'class:moved' ELSE target END AS target, edge_id % 3 <> 1 AS shown FROM edges WHERE kind = 'extends'")
def _(g, spark, sf):
    extends = g.edges.filter("kind = 'extends'")
    fixes = extends.select("edge_id", F.when(F.col("edge_id") % 3 == 0, "retarget").when(F.col("edge_id") % 3 == 1, "suppress").otherwise("verify").alias("action"), F.lit("class:moved").alias("new_target"))
    from graphloom.functions.columns import active_edge

    return store.correct_edges(extends, fixes).select("edge_id", "target", active_edge().alias("shown"))


@query("snk_07", """, s AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_full_match(x, '\\p{N}+'))) AS segment, name FROM nodes) SELECT segment, CAST(count(*) AS BIGINT) AS names FROM s GROUP BY segment""")
def _(g, spark, sf):
    from graphloom.operators.search import segment_vocabulary

    return segment_vocabulary(g.nodes).groupBy("segment").agg(F.count(F.lit(1)).alias("names"))


@query("src_03", "SELECT path, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.cpp' THEN 'cpp' END AS language FROM files")
def _(g, spark, sf):
    from graphloom.sources.extract import language_of

    return g.files.select("path", language_of(F.col("path")).alias("language"))


@query("src_07", "SELECT name, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE kind = 'function' AND language = 'cpp' AND list_contains(decorators, 'ECONOMY') GROUP BY name")
def _(g, spark, sf):
    return g.nodes.filter((F.col("kind") == "function") & (F.col("language") == "cpp") & F.array_contains("decorators", "ECONOMY")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("gr_13", "SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, CAST(count(*) AS BIGINT) AS files, min(path) AS first_path FROM files GROUP BY 1")
def _(g, spark, sf):
    where = folder(F.col("path"))
    return g.files.groupBy(F.when(where == "", ".").otherwise(where).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@query("rs_12", "SELECT language, CASE WHEN language IN ('typescript', 'javascript') THEN 'web' WHEN language = 'cpp' THEN 'c' WHEN language = 'java' THEN 'jvm' END AS family FROM (SELECT DISTINCT language FROM nodes)")
def _(g, spark, sf):
    return g.nodes.select("language").distinct().select("language", language_family(F.col("language")).alias("family"))
