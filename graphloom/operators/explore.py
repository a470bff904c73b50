"""What a task is shown: code blocks of the symbols found, files ranked around them, and symbols of a workspace under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import is_generated_file, is_test_file
from graphloom.operators import context, traversal
from graphloom.session import materialise

#: Characters of a line, and what ends a block that was cut.
CUT = "\n... (truncated) ..."
#: Share of the best file's score below which a file is buried, and terms that save it.
BURIED, SAVING_TERMS = 0.06, 2


def slices(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (file_path, start_line, end_line, ...) with content: the lines of each in files (path, source), from 1 and inclusive; files that are not there drop out."""
    lines = F.split("source", "\r?\n")
    joined = spans.join(files.select(F.col("path").alias("file_path"), "source"), "file_path")
    part = F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.lit(1)) + 1, F.lit(0)))
    return joined.withColumn("content", F.array_join(part, "\n")).drop("source")


def with_text(files: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans (file_path, start_line, end_line, ...) whose slice of their file is not empty, found without moving a file's text: two lines or more always hold something, and a single one does if it is not blank."""
    lines = F.split("source", "\r?\n")
    sizes = files.select(F.col("path").alias("file_path"), F.size(lines).alias("n_lines"))
    first, last = F.greatest(F.col("start_line"), F.lit(1)), F.least(F.col("end_line"), F.col("n_lines"))
    rows = spans.join(sizes, "file_path").withColumn("only", F.when(last == first, first)).withColumn("taken", last - first + 1).filter("taken > 0").drop("n_lines", "taken")
    alone = rows.filter("only IS NOT NULL").select("file_path", "only").distinct()
    blank = files.join(alone.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("file_path"), F.posexplode(lines).alias("at", "line")).filter("line = ''").select("file_path", (F.col("at") + 1).alias("only"))
    return rows.join(blank, ["file_path", "only"], "left_anti").drop("only")


def code_blocks(found: DataFrame, nodes: DataFrame, files: DataFrame, most: int = 5, size: int = 1500) -> DataFrame:
    """(place, id, file_path, start_line, end_line, language, content) of the first blocks of found (id, role, depth): entry points, then functions and methods, then classes; empty ones do not count, long ones are cut at `size` characters. Only the blocks shown are joined with the text of their files."""
    rank = F.when(F.col("role") == "entry", 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "class", 2)
    rows = found.join(nodes.select("id", "kind", "file_path", "start_line", "end_line", "language"), "id").withColumn("rank", rank).filter("rank IS NOT NULL")
    shown = with_text(files, rows).orderBy("rank", "depth", "id").limit(most)
    first = slices(files, shown)
    cut = F.when(F.length("content") > size, F.concat(F.substring("content", 1, size), F.lit(CUT))).otherwise(F.col("content"))
    order = Window.orderBy("rank", "depth", "id")  # over `most` rows
    return first.select(F.row_number().over(order).alias("place"), "id", "file_path", "start_line", "end_line", "language", cut.alias("content"))


def task_context(nodes: DataFrame, edges: DataFrame, files: DataFrame, question: str, most: int = 5, size: int = 1500, max_nodes: int = 20) -> tuple[DataFrame, DataFrame, str]:
    """The context of a question, its code blocks, and a sentence that counts them."""
    found = materialise(context.relevant_context(nodes, edges, question, max_nodes=max_nodes), "context")
    blocks = materialise(code_blocks(found, nodes, files, most, size), "blocks")
    n = found.join(nodes.select("id", "file_path"), "id").agg(F.count(F.lit(1)), F.countDistinct("file_path"), F.count_if(F.col("role") == "entry")).first()
    return found, blocks, f"{n[0]} symbols in {n[1]} files, {n[2]} of them entry points; {blocks.count()} code blocks."


def file_scores(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, graph_score): a random walk with restart at the entry points over the symbols found, summed by file."""
    score = traversal.random_walk(edges, found.select("id"), found.filter("role = 'entry'").select("id"))
    return score.join(nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.sum("score").alias("graph_score"))


def term_hits(path: Column, names: Column, terms: list[str]) -> Column:
    """How many of the terms a file's path or names (one text, lower case) hold."""
    return sum((F.when(F.lower(path).contains(t) | names.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def explore(nodes: DataFrame, edges: DataFrame, question: str, max_files: int = 8, entries: int = 8, depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """(place, file_path, tier, score, symbols) of the files that a question is about.

    Files group the context's symbols: 50 for an entry point, 10 for one next to
    it, 3 for another, 1 where only a path leads. Files whose walk score is under
    6 % of the best are buried, unless they hold an entry point or two of the
    terms, and if two or more are left. Order: entry files with two terms, then
    by walk score, terms, group score; tests and generated files after others.
    """
    found = materialise(context.relevant_context(nodes, edges, question, entries, depth, max_nodes), "explore")
    terms = context.terms_of(question, False)
    worth = F.when(F.col("role") == "entry", 50).when(F.col("depth") == 1, 10).when(F.col("depth") == 2, 3).otherwise(1)
    rows = found.join(nodes.select("id", "name", "file_path"), "id")
    groups = rows.groupBy("file_path").agg(F.sum(worth).alias("score"), F.array_sort(F.collect_set("id")).alias("symbols"), F.max(F.col("role") == "entry").alias("entry"), F.concat_ws(" ", F.collect_set(F.lower("name"))).alias("names"))
    scored = groups.join(file_scores(found, nodes, edges), "file_path", "left").na.fill(0.0, ["graph_score"]).withColumn("hits", term_hits(F.col("file_path"), F.col("names"), terms))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over the files of max_nodes symbols
    scored = scored.withColumn("best", F.max("graph_score").over(whole))
    scored = scored.withColumn("stays", (F.col("graph_score") >= BURIED * F.col("best")) | F.col("entry") | (F.col("hits") >= SAVING_TERMS))
    scored = scored.withColumn("left", F.sum(F.col("stays").cast("int")).over(whole)).filter("stays OR left < 2")
    low = is_test_file(F.col("file_path")) | is_generated_file(F.col("file_path"))
    tier = F.when(F.col("entry") & (F.col("hits") >= SAVING_TERMS), 0).when(F.col("entry"), 1).otherwise(2) + F.when(low, 3).otherwise(0)
    order = (tier, F.desc(F.round("graph_score", 9)), F.desc("hits"), F.desc("score"), "file_path")
    top = scored.orderBy(*order).limit(max_files)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "file_path", tier.alias("tier"), "score", "symbols")


def workspace_symbols(nodes: DataFrame, text: str, limit: int = 100, budget: int | None = 20_000, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> DataFrame:
    """(id, stage, exceeded) of an editor's symbol search.

    Filters hold before any cap. Stages: 0 for equal names, 1 for prefixes, 2
    for names with the text inside, 3 for qualified names; ties by qualified
    name, file, line, id. Candidates beyond `budget` are counted but not
    ordered: exceeded says so, and the first `budget` by stage and id are kept. Without
    a budget all candidates are ordered: a top-k per task, merged.
    """
    pool = nodes
    for column, wanted in (("kind", kinds), ("language", languages)):
        pool = pool.filter(F.col(column).isin(*wanted)) if wanted else pool
    for part in paths:
        pool = pool.filter(F.lower("file_path").contains(part.lower()))
    low, name = text.lower(), F.lower("name")
    stage = F.when(name == low, 0).when(name.startswith(low), 1).when(name.contains(low), 2).when(F.lower("qualified_name").contains(low), 3)
    hits = pool.select("id", "qualified_name", "file_path", "start_line", stage.alias("stage")).filter("stage IS NOT NULL")
    if budget is None:
        return hits.orderBy("stage", "qualified_name", "file_path", "start_line", "id").limit(limit).select("id", "stage", F.lit(False).alias("exceeded"))
    kept = hits.orderBy("stage", "id").limit(budget + 1)
    exceeded = F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > budget  # over `budget` rows
    return kept.withColumn("exceeded", exceeded).orderBy("stage", "qualified_name", "file_path", "start_line", "id").limit(limit).select("id", "stage", "exceeded")
