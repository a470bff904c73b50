"""Retrieval of what a task needs to see: ranked entry points, their neighbourhood, caps, and call chains."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import is_distinctive, is_test_file, kind_bonus, path_relevance
from graphloom.operators.search import bm25
from graphloom.operators.traversal import adjacency, reach
from graphloom.session import materialise

# Words that questions hold and that name nothing, by the step that drops them.
STOPWORDS = frozenset(
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each every how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such over only out its so up as if look need needs want happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called".split()
)
COMMON_WORDS = frozenset(
    "the and for with from this that have been will would could should does done make made use used using work works find found show call called calling get set add all any how what when where which who why not but are was were has had its can did may also into than then them each other some such only same about after before between through during without again further once here there both just more most very being having doing system need needs want wants like look change changes changed changing "
    "layer handle handles handling incoming outgoing data flow flows level levels request requests response responses implement implements implementation interface interfaces class classes method methods trigger triggers affected affect affects else code failing failed silently decide decides return returns returned take takes taken check checks checked create creates created read reads write writes written start starts stop stops run runs running".split()
)
PROSE_WORDS = frozenset(
    "about above actually after again against almost along also always another anything around away back because been before behind being below best better between both cannot come could does doing done down each either else even ever every everything fine first from getting give goes going gone good great have having help here inside instead into just keep know last least less like likely little look looking made make making many maybe mind more most much must need needs never next nice none nothing okay only onto other otherwise over please pretty probably quite rather really right same seem seems should show since some someone something somewhere soon still such sure take than thank thanks that their them then there these they thing things think this those though tried tries trying under until upon very want wants well went were what when which while will wish with within without would wrong your yours "
    "change changes check class classes code detail details directory error errors example examples file files folder function functions issue issues line lines method methods name names problem problems project question questions rename test tests type types update value values warning warnings work working write writing".split()
)
#: Output budgets by the number of files of a project: (files, calls).
BUDGETS = ((150, 1), (500, 2), (5_000, 3), (15_000, 4))


def stems(term: str) -> list[str]:
    """Forms of a term without its English suffix, three characters or more; they serve as prefixes, so they need not be words."""
    t, out = term.lower(), []

    def cut(n: int, *more: str) -> None:
        out.extend([t[: len(t) - n], *(t[: len(t) - n] + m for m in more)])

    def single(n: int) -> None:
        if t[-n - 1 : -n] == t[-n - 2 : -n - 1]:
            out.append(t[: len(t) - n - 1])

    if len(t) > 5 and t.endswith("ing"):
        cut(3, "e")
        single(3)
    if len(t) > 5 and t.endswith(("tion", "sion")):
        cut(3)
    if len(t) > 6 and t.endswith("ment"):
        cut(4)
    if len(t) > 4:
        if t.endswith("ies"):
            out.append(t[:-3] + "y")
        elif t.endswith("es"):
            cut(2)
        elif t.endswith("s") and not t.endswith("ss"):
            cut(1)
        if t.endswith("ed") and not t.endswith("eed"):
            cut(1)
            cut(2)
            if len(t) > 5 and t.endswith("ied"):
                out.append(t[:-3] + "y")
        if t.endswith("er"):
            cut(2, "e")
            single(2)
    return [v for v in dict.fromkeys(out) if len(v) >= 3 and v != t]


def terms_of(question: str, with_stems: bool = True) -> list[str]:
    """Search terms of a question: compounds with a camel boundary or an underscore, then the parts of all identifiers that are no stop words, then stems; in lower case."""
    compounds, parts = [], []
    for dotted in re.findall(r"[A-Za-z0-9_]+", question):
        for piece in filter(None, dotted.split("_")):
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", piece)
            if " " in spaced and len(piece) >= 3:
                compounds.append(piece)
            parts += spaced.split()
        if "_" in dotted and len(dotted) >= 3:
            compounds.append(dotted)
    words = list(dict.fromkeys([c.lower() for c in compounds] + [p.lower() for p in parts if len(p) >= 3 and p.lower() not in STOPWORDS]))
    more = [v for t in words for v in stems(t) if v not in STOPWORDS] if with_stems else []
    return list(dict.fromkeys(words + more))


#: Forms of identifiers in prose: camel case or a capitalised word, snake case, screaming snake case, acronyms, dotted names, plain lower-case words.
SYMBOL_FORMS = tuple(re.compile(p, flags) for p, flags in (
    (r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b", 0), (r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", re.I), (r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", 0),
    (r"\b[A-Z]{2,}\b", 0), (r"\b[a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+\b", 0), (r"\b[a-z][a-z0-9]{2,}\b", 0),
))


def symbols_of(question: str) -> list[str]:
    """Words of a question that may name a symbol, form by form; dotted names also by their parts; no common words."""
    found = []
    for form in SYMBOL_FORMS:
        for word in form.findall(question):
            found += [word, *(p for p in word.split(".") if "." in word and len(p) >= 2)]
    return [w for w in dict.fromkeys(found) if len(w) >= 2 and w.lower() not in COMMON_WORDS]


def plain_word(word: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.category(c).startswith("M")).lower()


def prose_words(question: str, most: int = 16) -> list[str]:
    """Words of 4 to 24 characters that may name a part of an identifier, in order, without accents; no numbers and no filler."""
    runs = [r for r in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", question)) if len(r) <= 24]
    words = (plain_word(r) for r in runs)
    return list(dict.fromkeys(w for w in words if 4 <= len(w) <= 24 and not w.isnumeric() and w not in PROSE_WORDS))[:most]


def variants(word: str) -> list[str]:
    """A word and what it may be the plural of. -es goes whole after x, sh, ss and zz; after ch, s, z and o either -es or -s may be the ending; other words lose an s, but -ss is no plural. What is left has four characters."""
    if re.search("(?:x|sh|ss|zz)es$", word):
        cuts = (2,)
    elif re.search("(?:ch|s|z|o)es$", word):
        cuts = (2, 1)
    else:
        cuts = (1,) if re.search("(?<!s)s$", word) else ()
    return [word, *(word[:-n] for n in cuts if len(word) - n >= 4)]


def budget(files: int) -> int:
    return next((calls for most, calls in BUDGETS if files < most), 5)


def entry_ranking(nodes: DataFrame, question: str, search_limit: int = 3, least: float = 0.3) -> DataFrame:
    """(id, score) of the nodes a question is about.

    Exact names, then prefixes, then text hits are merged by their best score;
    test files are held back, several matched terms raise a node, single plain
    words lower it.
    """
    terms, symbols = terms_of(question, False), [s.lower() for s in symbols_of(question)]
    low = F.lower("name")
    wanted = symbols or terms
    exact = nodes.filter(low.isin(*wanted)).select("id", F.lit(21.0 if len(wanted) > 1 else 1.0).alias("score"))
    prefix = None
    for t in terms:
        hit = nodes.filter(low.startswith(t) & (low != t) & F.col("kind").isin("class", "interface", "function", "method")).select("id", (15 + F.greatest(F.lit(0.0), 10 - (F.length("name") - len(t)) / 3)).alias("score"))
        prefix = hit if prefix is None else prefix.unionByName(hit)
    text = bm25(nodes, " ".join(terms)).orderBy(F.desc("score"), "id").limit(max(5 * search_limit, 100))
    merged = exact.unionByName(text) if prefix is None else exact.unionByName(prefix).unionByName(text)
    best = merged.groupBy("id").agg(F.max("score").alias("score")).join(nodes, "id")
    matched = sum((F.when(low.contains(t) | F.lower("file_path").contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    score = F.col("score") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), question)
    score = score * F.when(is_test_file(F.col("file_path")), 0.3).otherwise(1.0)
    if len(terms) >= 2:
        score = score * F.when(matched >= 2, 1 + 0.5 * matched).when(is_distinctive(F.col("name")) & low.isin(*wanted), 1.0).when(low.isin(*wanted), 0.3).otherwise(0.6)
    return best.select("id", score.alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(3 * search_limit)


def relevant_context(nodes: DataFrame, edges: DataFrame, question: str, search_limit: int = 3, depth: int = 1, max_nodes: int = 20) -> DataFrame:
    """(id, role, depth) of the entry points and what is around them, with caps: per file max(5, a fifth), tests max(3, 15 %)."""
    entries = materialise(entry_ranking(nodes, question, search_limit).orderBy(F.desc("score"), "id").limit(search_limit), "entries")
    around = reach(edges, entries.select("id"), "both", None, depth).join(entries, "id", "left")
    rows = around.join(nodes.select("id", "kind", "file_path"), "id").withColumn("role", F.when(F.col("score").isNotNull(), "entry").otherwise("near"))
    priority = F.when(F.col("role") == "entry", 10).otherwise(0) + kind_bonus(F.col("kind"))
    per_file, tests = max(5, -(-max_nodes // 5)), max(3, -(-15 * max_nodes // 100))
    rows = rows.withColumn("priority", priority).withColumn("nth", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("priority"), "depth", "id"))).filter(F.col("nth") <= per_file)
    rows = rows.withColumn("test", is_test_file(F.col("file_path"))).withColumn("kth", F.row_number().over(Window.partitionBy("test").orderBy(F.desc("priority"), "depth", "id")))
    kept = rows.filter(~F.col("test") | (F.col("kth") <= tests))
    return kept.orderBy(F.desc("priority"), "depth", "id").limit(max_nodes).select("id", "role", "depth")


def call_chains(edges: DataFrame, named: DataFrame, most_hops: int = 7) -> DataFrame:
    """(id, hops, parent) along calls from named nodes, with at most one unnamed node between two named ones.

    The streak of unnamed nodes travels with the frontier; a node is kept with
    its least hops, then least streak.
    """
    steps = adjacency(edges, "outgoing", ("calls",)).select("at", "to").distinct()
    marks = named.select(F.col("id").alias("to"), F.lit(True).alias("named")).distinct()
    seen = materialise(named.select("id", F.lit(0).alias("hops"), F.lit(0).alias("streak"), F.lit(None).cast("string").alias("parent")), "chain")
    frontier = seen
    for hop in range(1, most_hops + 1):
        new = frontier.select(F.col("id").alias("at"), "streak").join(steps, "at").join(marks, "to", "left")
        new = new.withColumn("streak", F.when(F.col("named"), 0).otherwise(F.col("streak") + 1)).filter("streak <= 1")
        best = new.groupBy(F.col("to").alias("id")).agg(F.min(F.struct("streak", "at")).alias("b")).select("id", F.lit(hop).alias("hops"), F.col("b.streak").alias("streak"), F.col("b.at").alias("parent"))
        frontier = materialise(best.join(seen.select("id"), "id", "left_anti"), "chain")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, roots: DataFrame, within: DataFrame, most_hops: int = 6, budget: int = 2000) -> DataFrame:
    """(path) of calls between nodes of a small set, three nodes or more; each level keeps `budget` paths, by their nodes."""
    ids = within.select(F.col("id").alias("to"))
    steps = materialise(adjacency(edges, "outgoing", ("calls",)).select("at", "to").distinct().join(ids, "to", "left_semi").select("at", "to"), "paths")
    level = materialise(roots.select(F.array("id").alias("path")), "paths")
    out = None
    for _ in range(most_hops):
        new = level.withColumn("at", F.element_at("path", -1)).join(steps, "at").filter(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"))
        level = materialise(new.orderBy("path").limit(budget), "paths")
        if not level.limit(1).count():
            break
        out = level if out is None else out.unionByName(level)
    rows = level if out is None else out
    return rows.filter(F.size("path") >= 3)


def matching_symbols(nodes: DataFrame, symbol: str) -> DataFrame:
    """Nodes that a written symbol can mean: its name, a file's stem, or a qualified suffix with ., :: or /."""
    parts = [p for p in re.split(r"\.|::|/", symbol) if p]
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    hit = (F.col("name") == symbol) | ((F.col("kind") == "file") & (stem == symbol))
    if len(parts) > 1:
        suffix = r"(?:^|[.:/])" + r"(?:\.|::|/)".join(re.escape(p) for p in parts) + "$"
        hit = hit | F.col("qualified_name").rlike(suffix)
    return nodes.filter(hit)
