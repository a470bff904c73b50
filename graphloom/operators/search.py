"""Lexical, semantic and hybrid search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import kind_bonus, name_match_bonus, path_relevance, segments
from graphloom.operators.lookups import gate

# Ranking constants.
FIELDS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str, kinds: tuple[str, ...] | None = None) -> ParsedQuery:
    """Splits field:value words off a query; quotes keep spaces, unknown fields and empty values are text."""
    out, words = ParsedQuery(), []
    for m in re.finditer(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', raw):
        prefix, value = (m[1] or "").lower(), m[2] if m[2] is not None else m[3]
        if prefix == "kind" and value and (kinds is None or value in kinds):
            out.kinds.append(value)
        elif prefix in ("lang", "language") and value:
            out.languages.append(value.lower())
        elif prefix == "path" and value:
            out.paths.append(value)
        elif prefix == "name" and value:
            out.names.append(value)
        else:
            words.append(m[0].replace('"', "") if m[2] is None else value)
    out.text = " ".join(w for w in words if w)
    return out


def query_terms(text: str) -> list[str]:
    """Prefix terms of a query: operators and punctuation are dropped."""
    plain = re.sub(r"['\"*():^]", " ", text.replace("::", " "))
    return [t.lower() for t in plain.split() if t not in ("AND", "OR", "NOT", "NEAR")]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(id, field, position, term) of the indexed fields."""
    each = [nodes.select("id", F.lit(f).alias("field"), F.posexplode(tokens(F.col(f))).alias("position", "term")) for f in FIELDS]
    return reduce(DataFrame.unionByName, each)


def bm25(nodes: DataFrame, text: str) -> DataFrame:
    """(id, score) of every node that has a query term as a prefix of a token.

    One pass over the token arrays: occurrences by field and length are counted
    in the row; only document frequencies and the mean length are aggregated.
    """
    terms = query_terms(text)
    if not terms:
        return nodes.sparkSession.createDataFrame([], "id string, score double")
    arrays = {f: tokens(F.col(f)) for f in FIELDS}
    hits = lambda f, t: F.size(F.filter(arrays[f], lambda x: x.startswith(t)))
    columns = {f"w{k}": reduce(lambda a, b: a + b, [FIELDS[f] * hits(f, t) for f in FIELDS]) for k, t in enumerate(terms)}
    any_hit = {f"n{k}": reduce(lambda a, b: a + b, [hits(f, t) for f in FIELDS]) for k, t in enumerate(terms)}
    length = reduce(lambda a, b: a + b, [F.size(arrays[f]) for f in FIELDS])
    counted = nodes.select("id", length.cast("double").alias("length"), *[v.alias(k) for k, v in {**columns, **any_hit}.items()])
    stats = counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"n{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    if not stats["rows"]:
        return nodes.sparkSession.createDataFrame([], "id string, score double")
    import math

    score, matched = F.lit(0.0), F.lit(False)
    for k in range(len(terms)):
        df = stats[f"df{k}"]
        idf = max(math.log((stats["rows"] - df + 0.5) / (df + 0.5)), 0) or LEAST_IDF
        f = F.col(f"w{k}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / float(stats["mean"])))
        matched = matched | (F.col(f"n{k}") > 0)
    return counted.filter(matched).select("id", score.alias("score"))


def like_search(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """(id, score): 1 equal, .9 prefix, .8 inside the name, .7 inside the qualified name, else .5; % and _ in the text are wildcards."""
    name, qualified = F.lower("name"), F.lower("qualified_name")
    low = text.lower()
    score = F.when(F.col("name") == text, 1.0).when(name.like(low + "%"), 0.9).when(name.like(f"%{low}%"), 0.8).when(qualified.like(f"%{low}%"), 0.7).otherwise(0.5)
    return nodes.filter(name.like(f"%{low}%") | qualified.like(f"%{low}%")).select("id", "name", score.alias("score")).orderBy(F.desc("score"), F.length("name"), "id").limit(limit)


def fuzzy_search(nodes: DataFrame, text: str, limit: int = 50, per_name: int = 5) -> DataFrame:
    """(id, name, distance, score): names within edit distance 1 (up to four characters) or 2; score 1 / (1 + distance)."""
    most = 1 if len(text) <= 4 else 2
    names = nodes.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(text.lower()), most)).filter("distance >= 0")
    ranked = nodes.join(names, "name").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("nth") <= per_name)
    return ranked.select("id", "name", "distance", (1.0 / (1 + F.col("distance"))).alias("score")).orderBy("distance", "name", "id").limit(limit)


def with_exact_names(found: DataFrame, pool: DataFrame, text: str, most: int = 20) -> DataFrame:
    """found (id, score) and, with the best of its scores, the first nodes that each word of the text names."""
    best = found.agg(F.max("score")).first()[0]
    words = [t.lower() for t in text.split()]
    first = Window.partitionBy(F.lower("name")).orderBy("id")
    exact = pool.filter(F.lower("name").isin(*words)).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most).select("id", F.lit(float(best or 0.0)).alias("score"))
    return found.unionByName(exact.join(found, "id", "left_anti"))


def search_nodes(nodes: DataFrame, raw: str, limit: int = 100) -> DataFrame:
    """The ranked search: full text, else substring, else fuzzy; exact names join with the best score; rescored by kind, path and name; trimmed, then gated."""
    q = parse_query(raw)
    pool = nodes
    if q.kinds:
        pool = pool.filter(F.col("kind").isin(*q.kinds))
    if q.languages:
        pool = pool.filter(F.col("language").isin(*q.languages))
    if not q.text:
        return gate(pool.select("id", "name", "kind", "file_path", F.lit(0.0).alias("score")).orderBy("name", "id").limit(limit), q.paths, q.names)
    fetch = max(5 * limit, 100)
    full = bm25(nodes, q.text).join(pool.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(fetch)
    found = full
    if not full.limit(1).count():
        found = like_search(pool, q.text, fetch).select("id", "score") if len(q.text) >= 2 else full
        if len(q.text) >= 3 and not found.limit(1).count():
            found = fuzzy_search(pool, q.text, max(2 * limit, 50)).select("id", "score")
    merged = with_exact_names(found, pool, q.text)
    rows = merged.join(pool.select("id", "name", "kind", "file_path"), "id")
    scored = rows.withColumn("score", F.col("score") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), q.text) + name_match_bonus(F.col("name"), q.text))
    return gate(scored.orderBy(F.desc("score"), "id").limit(limit), q.paths, q.names).select("id", "name", "kind", "file_path", "score")


def segment_vocabulary(nodes: DataFrame) -> DataFrame:
    """(segment, name), distinct; files and imports have none."""
    return nodes.filter(~F.col("kind").isin("file", "import")).select(F.explode(segments(F.col("name"))).alias("segment"), "name").distinct()


def segment_cooccurrence(vocabulary: DataFrame, variants: list[tuple[str, str]], least: int, limit: int) -> DataFrame:
    """(name, matches): names that have segments of at least `least` of the words; variants are (segment, word)."""
    wanted = vocabulary.sparkSession.createDataFrame(variants, "segment string, word string")
    hits = vocabulary.join(F.broadcast(wanted), "segment").groupBy("name").agg(F.countDistinct("word").alias("matches")).filter(F.col("matches") >= least)
    return hits.orderBy(F.desc("matches"), F.length("name"), "name").limit(limit)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a constant vector, in double precision; null where a norm is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return dot / F.nullif(norm * F.lit(own), F.lit(0.0))


def semantic_top_k(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """(id, similarity): the k nearest by cosine above 0, filtered first; ties by id. A top-k per task, merged."""
    pool = vectors if keep is None else vectors.filter(keep)
    return pool.select("id", cosine(F.col("vector"), query).alias("similarity")).filter("similarity > 0").orderBy(F.desc("similarity"), "id").limit(k)


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, limit: int, offset: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """(id, fused, match_type) of two ranked arms (id, rank): the sum of 1 / (60 + rank), ties by id. keep gates before the page is cut."""
    both = keyword.select("id", F.col("rank").alias("k")).join(semantic.select("id", F.col("rank").alias("s")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.select("id", (part("k") + part("s")).alias("fused"), F.when(F.col("s").isNull(), "keyword").when(F.col("k").isNull(), "semantic").otherwise("both").alias("match_type"))
    if keep is not None:
        fused = fused.join(keep.select("id"), "id", "left_semi")
    return fused.orderBy(F.desc("fused"), "id").offset(offset).limit(limit)


def ranked(rows: DataFrame, score: str, depth: int) -> DataFrame:
    """(id, rank): the first `depth` rows numbered by score. The limit comes first, so one task numbers a bounded list."""
    top = rows.orderBy(F.desc(score), "id").limit(depth)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc(score), "id")).alias("rank"))


def resolve_mode(asked: str, has_provider: bool, vectors: int) -> str:
    """auto is hybrid if there is a provider and a vector, else keyword."""
    return asked if asked != "auto" else "hybrid" if has_provider and vectors > 0 else "keyword"


def embedding_input(nodes: DataFrame, most: int = 6000) -> DataFrame:
    """(id, input, input_hash): what is embedded for a node, and its hash."""
    parts = F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "signature", F.regexp_replace("docstring", "\r\n?", "\n"))
    text = F.substring(parts, 1, most)
    return nodes.select("id", text.alias("input"), F.sha2(text, 256).alias("input_hash"))
