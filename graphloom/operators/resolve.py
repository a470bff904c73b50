"""Reference resolution: names to nodes, with a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import LANGUAGE_FAMILIES, base_name, folder_points, folders, language_family, leading_parts, own_folders, proximity

#: More candidates than this say nothing.
AMBIGUOUS = 500
CALLABLE = ("function", "method", "class")


def _candidates(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("target_file"), F.col("language").alias("target_language"), F.col("is_exported").alias("target_exported"), F.col("start_line").alias("target_line"))


def gate(language: Column, target_language: Column) -> Column:
    ours, theirs = language_family(language), language_family(target_language)
    return ours.isNull() | theirs.isNull() | (ours == theirs)


def language_gate() -> Column:
    """Candidates of another known language family are out."""
    return gate(F.col("language"), F.col("target_language"))


def gate_families(language: Column) -> Column:
    """The families, empty for an unknown one, that pass the gate with a language; it holds both ways."""
    family = language_family(language)
    return F.when(family.isNull(), F.array(*map(F.lit, ["", *LANGUAGE_FAMILIES]))).otherwise(F.array(family, F.lit("")))


def fit(kind: Column, language: Column, exported: Column) -> Column:
    """What of a candidate's score holds wherever it is: language, kind, export."""
    callable_ = kind.isin("function", "method")
    by_kind = F.when((F.col("reference_kind") == "calls") & callable_, 25).when((F.col("reference_kind") == "instantiates") & kind.isin("class", "struct", "interface"), 25).when((F.col("reference_kind") == "decorates") & callable_, 25).when((F.col("reference_kind") == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)
    return F.when(language == F.col("language"), 50).otherwise(-80) + by_kind + F.when(exported, 10).otherwise(0)


def line_bonus(target_line: Column) -> Column:
    """What a candidate in the same file gets for being near."""
    return F.greatest(F.lit(0.0), 20 - F.abs(target_line - F.col("line")) / 10)


def candidate_score(near: Column | None = None) -> Column:
    """How well a candidate fits its reference: file, folders, language, kind, export, distance. near: the points for folders, where they are known."""
    same_file = F.col("target_file") == F.col("file_path")
    near = proximity(F.col("file_path"), F.col("target_file")) if near is None else near
    return F.when(same_file, 100).otherwise(0) + near + fit(F.col("target_kind"), F.col("target_language"), F.col("target_exported")) + F.when(same_file, line_bonus(F.col("target_line"))).otherwise(0.0)


#: What of a reference decides between candidates, beside its line.
ASKED = ("reference_name", "file_path", "language", "reference_kind")


def _asked_only(pool: DataFrame, refs: DataFrame) -> DataFrame:
    """The candidates that some reference names."""
    return pool.join(refs.select(F.col("reference_name").alias("target_name")).distinct(), "target_name", "left_semi")


def candidate_pairs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with each candidate (target...) of their name that the language gate lets through, and near, the points for common folders. All pairs are the result, so their number is the product of both sides; the join is by name and family and makes no other pair, paths are split before it, and no pair is shuffled."""
    pool = _asked_only(_candidates(nodes), refs).withColumn("target_folders", folders(F.col("target_file"))).withColumn("family", F.explode(gate_families(F.col("target_language"))))
    asked = refs.withColumn("folders", own_folders(F.col("file_path"))).withColumn("family", F.coalesce(language_family(F.col("language")), F.lit("")))
    return asked.join(pool, (F.col("reference_name") == F.col("target_name")) & (asked["family"] == pool["family"])).withColumn("near", folder_points(F.col("folders"), F.col("target_folders"))).drop("family", "folders", "target_folders")


def best_candidates(refs: DataFrame, pool: DataFrame, prefer_same: bool = True) -> DataFrame:
    """refs that have candidates, with best (other, minus, target, near, kind): the candidate of the highest score, then by id; prefer_same puts those of the reference's language first. Also n (candidates), named (those out of reach too) and any_same (one has the reference's language).

    pool: candidates that the language gate judges; its column scopes, if there,
    holds the lines within which one can be reached, null for no such limit.

    No pair of reference and candidate is made. A score is the points for
    common folders and what holds anywhere, so of the candidates of a name in
    one folder, or below it, only the first by id of each language, kind and
    export can win: they are aggregated by every leading part of their path
    (folders beyond the cap of the points do not count), and each place that
    asks looks its own leading parts up. A candidate deeper down is rated too
    low by a shorter part and as it is by its longest common one, so the
    highest rating is the true one. Candidates in the file itself, whose lines
    count and which may be out of reach, come as one list for a name and file.
    """
    if "scopes" not in pool.columns:
        pool = pool.withColumn("scopes", F.lit(None).cast("array<struct<a:int,b:int>>"))
    pool = _asked_only(pool, refs)
    asks = refs.select(*ASKED).distinct()
    free, here = F.col("scopes").isNull(), F.col("target_file") == F.col("file_path")
    kinds = ["target_name", "target_language", "target_kind", "target_exported", F.col("target_file").isNull().alias("nowhere")]
    parts = pool.withColumn("part", F.explode(leading_parts(folders(F.col("target_file"))))).groupBy(*kinds, F.col("part.depth").alias("depth"), F.col("part.path").alias("part"))
    parts = parts.agg(F.count(F.lit(1)).alias("named"), F.count_if(free).alias("n"), F.min(F.when(free, F.col("target"))).alias("target"))
    looked = asks.withColumn("at", F.explode(leading_parts(own_folders(F.col("file_path"))))).join(parts, (F.col("reference_name") == F.col("target_name")) & (F.col("at.depth") == F.col("depth")) & (F.col("at.path") == F.col("part"))).filter(language_gate())
    rank = lambda language: F.when(language == F.col("language"), 0).otherwise(1) if prefer_same else F.lit(0)
    points = F.least(F.col("depth") * 15, F.lit(80))
    score = F.when(F.col("nowhere"), -1e9).otherwise(points + fit(F.col("target_kind"), F.col("target_language"), F.col("target_exported")))
    rated = F.struct(rank(F.col("target_language")).alias("other"), (-score.cast("double")).alias("minus"), "target", points.alias("near"), F.col("target_kind").alias("kind"))
    whole = F.col("depth") == 0
    same = F.col("target_language") == F.col("language")
    found = looked.groupBy(*ASKED).agg(F.sum(F.when(whole, F.col("named"))).alias("named"), F.sum(F.when(whole, F.col("n"))).alias("n"), F.max(F.when(F.col("n") > 0, same)).alias("any_same"), F.min(F.when(F.col("target").isNotNull(), rated)).alias("best"))
    places = asks.select("reference_name", "file_path").distinct()
    local = pool.join(places, (F.col("target_name") == F.col("reference_name")) & here).groupBy("reference_name", "file_path").agg(F.collect_list(F.struct("target", "target_line", "target_language", "target_kind", "target_exported", "scopes")).alias("local"))
    own = folders(F.col("file_path"))
    found = found.join(local, ["reference_name", "file_path"], "left").withColumn("own_near", F.when(F.col("local").isNotNull(), folder_points(own_folders(F.col("file_path")), own)))
    keys = [F.col(f"refs.{k}").eqNullSafe(F.col(f"found.{k}")) for k in ASKED]
    rows = refs.alias("refs").join(found.alias("found"), reduce(Column.__and__, keys)).select("refs.*", *[f"found.{c}" for c in ("named", "n", "any_same", "best", "local", "own_near")])
    passes = lambda x: gate(F.col("language"), x["target_language"]) & (x["scopes"].isNull() | F.exists(x["scopes"], lambda s: F.col("line").between(s["a"], s["b"])))
    placed = lambda x: F.struct(rank(x["target_language"]).alias("other"), (-(100 + F.col("own_near") + fit(x["target_kind"], x["target_language"], x["target_exported"]) + line_bonus(x["target_line"]))).cast("double").alias("minus"), x["target"].alias("target"), F.col("own_near").alias("near"), x["target_kind"].alias("kind"))
    rows = rows.withColumn("local", F.filter("local", passes)).withColumn("held", F.filter("local", lambda x: x["scopes"].isNotNull()))
    held_same = F.array_max(F.transform("held", lambda x: x["target_language"] == F.col("language")))
    return rows.withColumns({"n": F.col("n") + F.when(F.col("held").isNotNull(), F.size("held")).otherwise(0), "any_same": F.greatest("any_same", held_same), "best": F.least("best", F.array_min(F.transform("local", placed)))}).filter("best IS NOT NULL").drop("local", "held", "own_near")


def by_exact_name(refs: DataFrame, nodes: DataFrame, most: int | None = AMBIGUOUS, lexical: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): one candidate .9 (.5 in another language); of several the best, .7 if near, else .4; none of more than `most`, if that is given.

    lexical: functions within functions count only where scope reaches them,
    if nodes say where they end. keep: columns of refs, or target_kind, that go
    along. Candidates are counted as the language gate lets them through.
    """
    pool = _candidates(nodes.filter("kind <> 'import'"))
    if lexical and "end_line" in nodes.columns:
        from graphloom.operators.receivers import with_scopes

        pool = with_scopes(_asked_only(pool, refs), nodes)
    rows = best_candidates(refs, pool)
    if most is not None:
        rows = rows.filter(F.col("named") <= most)
    rows = rows.filter("n = 1 OR (any_same IS NOT NULL AND best.minus < 1 AND file_path IS NOT NULL)")
    confidence = F.when(F.col("n") == 1, F.when(F.col("best.other") == 0, 0.9).otherwise(0.5)).when(F.col("best.near") >= 30, 0.7).otherwise(0.4)
    return rows.select("ref_id", F.col("best.target").alias("target"), confidence.alias("confidence"), F.lit("exact-match").alias("resolved_by"), *[F.col("best.kind").alias(k) if k == "target_kind" else F.col(k) for k in keep])


def by_file_path(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Path references to files: equal .95, suffix .85 (the closest), a base name that only one file has .7."""
    pool = files.select(F.col("path").alias("target"), base_name(F.col("path")).alias("base"))
    joined = refs.withColumn("base", base_name(F.col("reference_name"))).join(pool, "base")
    equal, suffix = F.col("target") == F.col("reference_name"), F.col("target").endswith(F.concat(F.lit("/"), F.col("reference_name")))
    alone = F.count(F.lit(1)).over(Window.partitionBy("ref_id")) == 1
    scored = joined.withColumn("confidence", F.when(equal, 0.95).when(suffix, 0.85).when(alone, 0.7)).filter("confidence IS NOT NULL")
    order = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), F.desc(proximity(F.col("file_path"), F.col("target"))), "target")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("ref_id", "target", "confidence", F.lit("file-path").alias("resolved_by"))


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Qualified references: the only node of that name, or the one in the same file, .95; else a suffix .85."""
    pool = _candidates(nodes)
    tail = lambda c: F.regexp_extract(c, r"[^.:]*$", 0)
    named = refs.filter(F.col("reference_name").rlike(r"[.:]")).withColumn("tail", tail(F.col("reference_name"))).join(pool.withColumn("tail", tail(F.col("target_qualified"))), "tail").filter(language_gate())
    equal = F.col("target_qualified") == F.col("reference_name")
    suffix = F.col("target_qualified").endswith(F.concat(F.lit("."), F.col("reference_name"))) | F.col("target_qualified").endswith(F.concat(F.lit("::"), F.col("reference_name")))
    n = F.count(F.when(equal, 1)).over(Window.partitionBy("ref_id"))
    same_file = F.col("target_file") == F.col("file_path")
    scored = named.withColumn("confidence", F.when(equal & ((n == 1) | same_file), 0.95).when(equal | suffix, 0.85)).filter("confidence IS NOT NULL")
    order = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), F.desc(same_file.cast("int")), F.desc(proximity(F.col("file_path"), F.col("target_file"))), "target")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("ref_id", "target", "confidence", F.lit("qualified-name").alias("resolved_by"))


def by_lower_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only callable of that name in any case: .5, .3 in another language. Candidates are counted by name and language, and a reference meets the counts of its name, so no pair of reference and candidate is made."""
    pool = _candidates(nodes.filter(F.col("kind").isin(*CALLABLE))).select(F.lower("target_name").alias("low"), "target_language", "target")
    counted = pool.repartition("low").groupBy("low", "target_language").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    names = counted.groupBy("low").agg(F.collect_list(F.struct("target_language", "n", "target")).alias("counts"))
    joined = refs.select("ref_id", "language", F.lower("reference_name").alias("low")).join(names, "low").withColumn("counts", F.filter("counts", lambda c: gate(F.col("language"), c["target_language"])))
    same = lambda c: c["target_language"] == F.col("language")
    known = F.array_max(F.transform("counts", same))
    kept = joined.withColumn("any_same", known).withColumn("counts", F.filter("counts", lambda c: ~F.col("any_same") | same(c))).filter(F.size("counts") == 1).filter(F.col("counts")[0]["n"] == 1)
    return kept.select("ref_id", F.col("counts")[0]["target"].alias("target"), F.when(F.col("any_same"), 0.5).otherwise(0.3).alias("confidence"), F.lit("fuzzy").alias("resolved_by"))


def resolve(refs: DataFrame, nodes: DataFrame, files: DataFrame, more: list[DataFrame] = (), most: int | None = AMBIGUOUS) -> DataFrame:
    """The best answer of all strategies: by confidence, then by the order of strategies. most: as for by_exact_name. more: answers (ref_id, target, confidence, resolved_by) of imports, receivers or frameworks, which come first."""
    strategies = [*more, by_file_path(refs.filter(F.col("reference_name").contains("/")), files), by_qualified_name(refs, nodes), by_exact_name(refs, nodes, most), by_lower_name(refs, nodes)]
    found = reduce(DataFrame.unionByName, [s.withColumn("place", F.lit(k)) for k, s in enumerate(strategies)])
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("confidence"), "place", "target"))).filter("nth = 1").drop("nth", "place")


def settle(refs: DataFrame, nodes: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of resolved references, and the references left, with status failed: one pass over all that are pending."""
    edges = make_edges(resolved, refs, nodes)
    left = refs.join(edges.select("ref_id"), "ref_id", "left_anti").withColumn("status", F.lit("failed"))
    return edges, left


#: Columns of a reference that its edge needs; answers that bring them are not joined with refs again.
EDGE_PARTS = ("from_node_id", "reference_name", "reference_kind", "line")


def make_edges(resolved: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references; kinds follow what the ends are: function values are references, inheriting from an interface implements, calling a class instantiates."""
    kinds = nodes.select("id", "kind")
    rows = resolved if set(EDGE_PARTS) <= set(resolved.columns) else resolved.join(refs, "ref_id")
    rows = rows if "target_kind" in rows.columns else rows.join(kinds.toDF("target", "target_kind"), "target")
    rows = rows.join(kinds.toDF("from_node_id", "source_kind"), "from_node_id")
    abstract = F.col("target_kind").isin("interface", "protocol") & ~F.col("source_kind").isin("interface", "protocol")
    kind = F.when(F.col("reference_kind") == "function_ref", "references").when((F.col("reference_kind") == "extends") & abstract, "implements").when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("class", "struct"), "instantiates").otherwise(F.col("reference_kind"))
    metadata = F.to_json(F.struct("confidence", F.col("resolved_by").alias("resolvedBy"), F.col("reference_name").alias("refName")))
    return rows.select("ref_id", F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line", "confidence", metadata.alias("metadata"))


def reattach(edges: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to re-indexed targets: moved to the new node of the same kind and name (the last one), and the edges that have none."""
    keyed = edges.join(old_nodes.select(F.col("id").alias("target"), F.col("kind").alias("k"), F.col("name").alias("n")), "target")
    last = new_nodes.groupBy(F.col("kind").alias("k"), F.col("name").alias("n")).agg(F.max_by("id", F.struct("start_line", "id")).alias("new_target"))
    joined = keyed.join(last, ["k", "n"], "left")
    return joined.filter("new_target IS NOT NULL").select("edge_id", "source", F.col("new_target").alias("target"), "kind"), joined.filter("new_target IS NULL").select("edge_id", F.col("source").alias("from_node_id"), F.col("n").alias("reference_name"), F.col("kind").alias("reference_kind"))


def supertypes(edges: DataFrame, roots: DataFrame, levels: int = 5) -> DataFrame:
    """(id, depth) of supertypes up to five levels."""
    from graphloom.functions.columns import HIERARCHY_KINDS
    from graphloom.operators.traversal import reach

    return reach(edges, roots, "outgoing", HIERARCHY_KINDS, levels).filter("depth > 0")
