"""Rules for terms, stems, symbols and plurals, held by examples; clustering of parts against the whole graph."""

import random

from graphloom.operators import catalogs, context


def test_stems():
    assert context.stems("caching") == ["cach", "cache"]
    assert set(context.stems("running")) == {"runn", "runne", "run"}
    assert context.stems("eviction") == ["evict"] and context.stems("expression") == ["express"]
    assert context.stems("management") == ["manage"]
    assert context.stems("entries") == ["entry"] and context.stems("processes") == ["process"] and context.stems("errors") == ["error"]
    assert context.stems("class") == [] and context.stems("feed") == []
    assert set(context.stems("carried")) == {"carrie", "carri", "carry"}
    assert set(context.stems("getter")) == {"gett", "gette", "get"}
    assert context.stems("ring") == [] and context.stems("bus") == []


def test_terms():
    assert context.terms_of("how does scrapeLoop handle app.isPackaged", False) == ["scrapeloop", "ispackaged", "scrape", "loop", "handle", "app", "packaged"]
    assert context.terms_of("max_retry_count", False) == ["max_retry_count", "max", "retry", "count"]
    assert "cache" in context.terms_of("caching") and context.terms_of("the file of it") == []


def test_symbols():
    assert context.symbols_of("how does UserService call get_user or MAX_SIZE via app.isPackaged in HTTP") == ["UserService", "isPackaged", "get_user", "MAX_SIZE", "HTTP", "app.isPackaged", "app", "via"]
    assert context.symbols_of("what does this system do") == []


def test_prose_and_plurals():
    assert context.prose_words("les Références de résolution, fix THIS 12345 typo checkout checkout") == ["references", "resolution", "typo", "checkout"]
    assert len(context.prose_words(" ".join(f"word{chr(97 + k)}x" for k in range(26)))) == 16
    assert context.variants("boxes") == ["boxes"] and context.variants("hashes") == ["hashes", "hash"]
    assert context.variants("caches") == ["caches", "cach", "cache"] and context.variants("services") == ["services", "service"]
    assert context.variants("class") == ["class"] and context.variants("machines") == ["machines", "machine"]


def modularity(links, label):
    total = 2 * sum(w for *_, w in links)
    degree, inside = {}, 0.0
    for a, b, w in links:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
        inside += 2 * w * (label[a] == label[b])
    mass = {}
    for v, d in degree.items():
        mass[label[v]] = mass.get(label[v], 0) + d
    return inside / total - sum((m / total) ** 2 for m in mass.values())


def random_parts(rng):
    links = []
    for part in "ab":
        pairs = {tuple(sorted((f"{part}{rng.randrange(9)}", f"{part}{rng.randrange(9)}"))) for _ in range(16)}
        links += [(a, b, float(rng.randint(1, 4))) for a, b in sorted(pairs) if a != b]
    return links


def grouped(label):
    out = {}
    for v, c in label.items():
        out.setdefault(c, set()).add(v)
    return {frozenset(x) for x in out.values()}


def test_parts_cluster_as_the_whole_graph(spark):
    rng = random.Random(2)
    for _ in range(20):
        links = random_parts(rng)
        files = sorted({x for a, b, _ in links for x in (a, b)})
        whole = catalogs.louvain_communities(links, files)
        total = 2 * sum(w for *_, w in links)
        apart = [catalogs.louvain_communities([x for x in links if x[0][0] == p], [f for f in files if f[0] == p], total) for p in "ab"]
        assert grouped(whole) == grouped(apart[0]) | grouped(apart[1])
        assert modularity(links, whole) >= modularity(links, {f: i for i, f in enumerate(files)})
    graph = spark.createDataFrame([(a, b, int(w)) for a, b, w in links], "a string, b string, weight long")
    got = catalogs.louvain(graph, spark.createDataFrame([(f,) for f in [*files, "alone"]], "path string"))
    assert grouped({r.path: r.community for r in got.collect()}) == grouped(whole) | {frozenset({"alone"})}


def test_communities_known_by_hand():
    ring = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)]
    assert catalogs.louvain_communities(ring, list("abcdefg")) == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1, "g": 2}
    assert catalogs.louvain_communities([], ["x", "y"]) == {"x": 0, "y": 1}
