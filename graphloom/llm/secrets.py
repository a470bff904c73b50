"""Secret scans with multipart credential linking (DataFrame functions only).

Base findings are fixed patterns: `assign` (a keyword, : or =, a value of 12
or more characters), `access` (AKIA and 14 or more) and `hex` (16 or more).

Linking adds weak parts, which would be noise alone: identifiers (user,
login, client or key ids with a value), opaque or short secrets, and endpoint
addresses. An interval join within the document meets each weak part with the
parts of the complementary kinds whose spans lie within SCOPE code points, by
bins of that width, each pair in the first bin that both fall into: a weak
secret is reported if an identifier is that near, a weak identifier if a secret
is, an endpoint if both are. The nearest of each kind is its link. Parts of one
kind do not overlap, so a part has no more partners than its scope has room
for, however dense a document is. Weak parts never overlap base findings.

Places come from the pieces that a pattern splits the text into: the running
sum of the lengths of pieces and matches. Only lengths and places are shuffled.

Defined cases: null text counts as empty; a document without findings has
zero counts, the digest of the empty string, empty spans and no links; repeated rows and
null ids give a row each; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import id_and_text, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""(?i:user_?(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
LEAST_ASSIGNED, LEAST_WEAK = 12, 6
#: Code points between two parts of one credential at most.
SCOPE = 300
#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]


def _matches(kind: str, pattern: str, needs: str | None = None) -> Column:
    """Array of (kind, nth, gap, width, value): every match, the text between it and the one before, and the width of its first group."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    grouped = pattern in (ASSIGN, IDENTIFIER)
    array = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("width"), (F.length(F.regexp_extract(z["m"], pattern, 1)) if grouped else F.length(z["m"])).alias("value")))
    hit = text.rlike(pattern) if needs is None else text.contains(needs) & text.rlike(pattern)
    return F.when(hit, array)


def candidate_parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end): all parts with their places; a document without any has one row with a null kind."""
    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    found = [_matches("assign", ASSIGN), _matches("access", ACCESS, "AKIA"), _matches("hex", HEX), _matches("identifier", IDENTIFIER), _matches("secret", OPAQUE), _matches("endpoint", ENDPOINT, "://")]
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,nth:int,gap:int,width:int,value:int>>")
    parts = rows.select("row", "doc_id", F.explode_outer(F.flatten(F.array(*[F.coalesce(f, none) for f in found]))).alias("p")).repartition("row")
    earlier = Window.partitionBy("row", "p.kind").orderBy("p.nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("p.gap").cast("long") + F.col("p.width")).over(earlier)
    placed = parts.select("row", "doc_id", F.col("p.kind").alias("found"), F.col("p.value").alias("value"), (ends - F.col("p.width")).alias("start"), ends.alias("end"))
    short = (F.col("found") == "assign") & (F.col("value") < LEAST_ASSIGNED)
    kind = F.when(short, F.when(F.col("value") >= LEAST_WEAK, F.lit("secret"))).otherwise(F.col("found"))
    return placed.select("row", "doc_id", kind.alias("kind"), "start", "end")


#: Kinds that complement a weak kind; an endpoint needs one of each group.
IDS, KEYS = ("access", "identifier"), ("assign", "hex", "secret")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, kind, rank, start, end, links): the weak parts to report, with the nearest complementary part of each group that they need."""
    ranked = parts.filter("kind IS NOT NULL").withColumn("rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")))
    bin_of = lambda place: F.floor(place / scope).cast("long")
    weak = ranked.filter(~F.col("kind").isin(*BASE)).withColumn("first", bin_of(F.greatest(F.col("start") - scope, F.lit(0)))).withColumn("bin", F.explode(F.sequence("first", bin_of(F.col("end") + scope))))
    other = ranked.select("row", *[F.col(c).alias(f"o_{c}") for c in ("kind", "rank", "start", "end")], bin_of(F.col("start")).alias("o_first")).withColumn("bin", F.explode(F.sequence("o_first", bin_of(F.col("o_end")))))
    apart = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    met = weak.join(other, ["row", "bin"]).filter((F.col("bin") == F.greatest("first", "o_first")) & (apart <= scope))
    overlap = F.col("o_kind").isin(*BASE) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    said = F.concat_ws(":", "o_kind", "o_start", "o_end")
    nearest = lambda kinds: F.min(F.when(F.col("o_kind").isin(*kinds), F.struct(F.greatest(apart, F.lit(0)).alias("apart"), F.col("o_start"), F.col("o_rank"), F.col("o_end"), said.alias("said"))))
    found = met.groupBy("row", "doc_id", "kind", "rank", "start", "end").agg(F.max(overlap).alias("covered"), nearest(IDS).alias("id"), nearest(KEYS).alias("key"))
    needs = [(("secret", "endpoint"), "id"), (("identifier", "endpoint"), "key")]
    enough = ~F.col("covered")
    for kinds, group in needs:
        enough = enough & (~F.col("kind").isin(*kinds) | F.col(group).isNotNull())
    links = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.col(f"{group}.said")) for kinds, group in needs]))
    return found.filter(enough).select("row", "doc_id", "kind", "rank", "start", "end", links.alias("links"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and links (weak part>partner) of every document."""
    parts = written(candidate_parts(docs), "secret-parts")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    sure = parts.select("row", "doc_id", F.when(F.col("kind").isin(*BASE), F.col("kind")).alias("kind"), rank.alias("rank"), "start", "end", F.array().cast("array<string>").alias("links"))
    span = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("said"), "links")
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, span)))
    spans = lambda keep: F.array_join(F.transform(listed(keep), lambda s: s["said"]), ",")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    linked = F.flatten(F.transform(listed(F.size("links") > 0), lambda s: F.transform(s["links"], lambda o: F.concat(s["said"], F.lit(">"), o))))
    return sure.unionByName(linked_parts(parts, scope)).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans(F.col("kind").isin(*BASE)), 256).alias("base_sha256"),
        spans(F.col("kind").isNotNull()).alias("spans"),
        F.count(F.when(~F.col("kind").isin(*BASE), 1)).alias("n_linked"),
        F.array_join(linked, ",").alias("links"),
    ).drop("row")


def _oracle_sql() -> str:
    """The same in SQL for small tables: places by sums over lists, links by a join of a document's parts."""
    any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    quoted = lambda pattern: pattern.replace("'", "''")
    assign = "(?:" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + ASSIGN.split(")", 1)[1]
    identifier = "(?:" + "|".join(map(any_case, ("user_?(?:name)?", "login", "account", "client_?id", "access_?key(?:_?id)?"))) + ")" + IDENTIFIER.split("(?:_?id)?)", 1)[1]
    opaque = "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"
    kinds = [("assign", assign, 1, f"length(v) >= {LEAST_ASSIGNED}"), ("secret", assign, 1, f"length(v) BETWEEN {LEAST_WEAK} AND {LEAST_ASSIGNED - 1}"), ("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 18"), ("hex", "[0-9a-f]+", 0, "length(m) >= 16"), ("identifier", identifier, 1, "TRUE"), ("secret", "[A-Za-z0-9+/_-]+", 0, opaque), ("endpoint", ENDPOINT, 0, "TRUE")]
    found = " UNION ALL ".join(
        f"SELECT row, '{kind}' AS kind, b AS s, b + length(m) AS e FROM (SELECT row, ms[i] AS m, vs[i] AS v, coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS b FROM (SELECT row, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT row, regexp_extract_all(x, '{quoted(pattern)}', 0) AS ms, regexp_extract_all(x, '{quoted(pattern)}', {group}) AS vs, string_split_regex(x, '{quoted(pattern)}') AS gs FROM t))) WHERE {rule}"
        for kind, pattern, group, rule in kinds
    )
    near = lambda ks: f"list_sort(list({{'apart': greatest(o.s - p.e, p.s - o.e, 0), 's': o.s, 'rank': {rank.replace('kind', 'o.kind')}, 'e': o.e, 'said': o.kind || ':' || o.s || ':' || o.e}}) FILTER (o.kind IN ({ks})))[1].said"
    rank = "list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], kind)"
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, " + rank + ")"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x FROM documents),
p AS MATERIALIZED ({found}),
m AS (SELECT p.row, p.kind, p.s, p.e, coalesce(bool_or(o.{base} AND o.s < p.e AND p.s < o.e), FALSE) AS covered, {near("'access', 'identifier'")} AS id, {near("'assign', 'hex', 'secret'")} AS key FROM p JOIN p o ON o.row = p.row AND p.s - o.e <= {SCOPE} AND o.s - p.e <= {SCOPE} WHERE NOT p.{base} GROUP BY ALL),
k AS (SELECT row, kind, s, e, [] AS links FROM p WHERE {base} UNION ALL SELECT row, kind, s, e, list_filter([CASE WHEN kind <> 'identifier' THEN id END, CASE WHEN kind <> 'secret' THEN key END], lambda x: x IS NOT NULL) FROM m WHERE NOT covered AND (kind = 'identifier' OR id IS NOT NULL) AND (kind = 'secret' OR key IS NOT NULL)),
a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {said} FILTER ({base}) AS base, {said} AS spans, count(*) FILTER (NOT {base}) AS n_linked, string_agg(array_to_string(list_transform(links, lambda o: kind || ':' || s || ':' || e || '>' || o), ','), ',' ORDER BY s, {rank}) FILTER (len(links) > 0) AS links FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked, coalesce(links, '') AS links FROM t LEFT JOIN a USING (row)
"""


ORACLE_SQL = _oracle_sql()
