import itertools
import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import index as ix
from kelpline.operators import proximity as px
from kelpline.plans import api, parse
from kelpline.plans.execute import hits
from kelpline.plans.tree import OPTIONAL, Leaf, Node, read

WORDS = list("abcdef")


def occurrences(spark, rows):
    docs = spark.createDataFrame([(i, t, "src0") for i, t in rows], "doc_id long, text string, source string")
    return ix.word_occurrences(docs)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))) for i in range(120)]


@pytest.fixture(scope="module")
def occ(spark, table):
    return occurrences(spark, table).cache()


def holds(node, words):
    if isinstance(node, Leaf):
        return node.kind == OPTIONAL or node.term in words
    kids = [c for c in node.children if not (isinstance(c, Leaf) and c.kind == OPTIONAL)]
    if node.op in ("OR", "OR_MAX"):
        return any(holds(c, words) for c in kids)
    if not all(holds(c, words) for c in kids):
        return False
    if node.op in ("AND", "ROOT"):
        return True
    places = [[i for i, w in enumerate(words) if w in {x.term for x in ([c] if isinstance(c, Leaf) else c.children)}] for c in kids]
    for p in itertools.product(*places):
        if node.op == "PHRASE" and all(p[i + 1] - p[i] == 1 for i in range(len(p) - 1)):
            return True
        if node.op == "PROX" and max(p) - min(p) <= node.distance:
            return True
        if node.op == "ORDERED_PROX" and list(p) == sorted(p) and p[-1] - p[0] <= node.distance:
            return True
    return False


TREES = [
    Node("AND", [Leaf("a"), Leaf("b")]),
    Node("AND", [Leaf("a"), Leaf("b"), Leaf("c")]),
    Node("OR", [Leaf("a"), Node("AND", [Leaf("b"), Leaf("c")])]),
    Node("ROOT", [Node("AND", [Leaf("a"), Leaf("c", OPTIONAL)])]),
    Node("PHRASE", [Leaf("a"), Leaf("b")]),
    Node("PHRASE", [Leaf("a"), Leaf("b"), Leaf("a")]),
    Node("PROX", [Leaf("a"), Leaf("b"), Leaf("c")], 3),
    Node("ORDERED_PROX", [Leaf("a"), Leaf("b"), Leaf("c")], 4),
    Node("PROX", [Node("OR_MAX", [Leaf("a"), Leaf("b", basic=False)]), Leaf("c")], 2),
]


@pytest.mark.parametrize("tree", TREES, ids=lambda t: t.sexp()[:40])
def test_trees_against_brute_force(occ, table, tree):
    got = {r["doc"] for r in hits(occ, tree).collect()}
    assert got == {i for i, t in table if holds(tree, t.split())}


def test_inclusions(occ):
    kids = lambda: [Leaf("a"), Leaf("b")]
    sets = [{r["doc"] for r in hits(occ, t).select("doc").collect()} for t in (Node("PHRASE", kids()), Node("ORDERED_PROX", kids(), 1), Node("PROX", kids(), 1), Node("AND", kids()), Node("OR", kids()))]
    assert all(x <= y for x, y in zip(sets, sets[1:]))


def test_boolean_fixture(spark):
    a, b, c = {1, 3, 5, 7}, {3, 4, 7}, {7, 9}
    rows = [(i, " ".join(n for n, s in (("aa", a), ("bb", b), ("cc", c)) if i in s)) for i in sorted(a | b | c)]
    o = occurrences(spark, rows)
    find = lambda t: {r["doc"] for r in hits(o, t).collect()}
    assert find(Node("AND", [Leaf("aa"), Leaf("bb")])) == {3, 7}
    assert find(Node("OR", [Leaf("aa"), Leaf("bb")])) == {1, 3, 4, 5, 7}
    assert find(Node("AND", [Leaf("aa"), Leaf("bb"), Leaf("cc")])) == {7}
    with_c = {r["doc"]: r["score"] for r in hits(o, Node("AND", [Leaf("aa"), Leaf("cc", OPTIONAL)])).collect()}
    alone = {r["doc"]: r["score"] for r in hits(o, Leaf("aa")).collect()}
    assert with_c.keys() == a and [i for i in a if abs(with_c[i] - alone[i]) > 1e-9] == [7]


def test_position_fixture(spark):
    data = {1: ([5, 9], [6]), 2: ([3], [2, 5]), 3: ([8], [6]), 4: ([1], [9])}
    rows = [(d, p, t, 0, 1.0, 0, 10) for d, (x, y) in data.items() for t, ps in (("x", x), ("y", y)) for p in ps]
    o = spark.createDataFrame(rows, "doc long, pos int, term string, index_type int, score double, feature long, len int")
    find = lambda t: {r["doc"] for r in hits(o, t).collect()}
    kids = lambda: [Leaf("x"), Leaf("y")]
    assert find(Node("PHRASE", kids())) == {1} == {r["doc"] for r in px.phrase_by_key(o, ["x", "y"]).collect()}
    assert find(Node("PROX", kids(), 3)) == {1, 2, 3}
    assert find(Node("ORDERED_PROX", kids(), 3)) == {1, 2}
    assert {r["doc"]: r["distance"] for r in px.minimum_forward_distance(o, "x", "y").collect()} == {1: 1, 2: 2, 3: None, 4: 8}


def test_sexp_round_trip():
    for t in TREES:
        assert read(t.sexp()).sexp() == t.sexp()
    got = read("( (ROOT (OR ((hotel 1 2 1 0 0)) ((s246:inn 1 2 0 0 0)) ) ) )")
    assert got.op == "ROOT" and [x.term for x in got.children[0].children] == ["hotel", "s246:inn"]
    for bad in ("(ROOT", ")", "(ROOT ((a 1)) ) x"):
        with pytest.raises(ValueError):
            read(bad)


def test_language():
    o = parse.Options(dependencies=False)
    sexp = lambda q, lex=parse.Lexicon(), o=o: parse.parse(q, lex, o)[0].sexp()
    assert sexp('"big red"').startswith("(ROOT (PHRASE ((big")
    assert sexp("x-y~3W").startswith("(ROOT (ORDERED_PROX 3 ((x ")
    assert sexp("x-y~3w").startswith("(ROOT (PROX 3 ((x ")
    assert sexp("x-y~OR").startswith("(ROOT (OR ") and sexp("x-y~AND").startswith("(ROOT (AND ")
    assert sexp("x y").startswith("(PROX 100 (ROOT ((x ")
    lex = parse.Lexicon(synonyms={"dog": [f"s{i}:d" for i in range(9)]}, df=lambda t: float(len(t)))
    tree, _ = parse.parse("dog", lex, o)
    assert tree.children[0].op == "OR_MAX" and len(tree.children[0].children) == 6
    assert parse.parse("site:a.example dog", lex, o)[1].site == "a.example"
    assert parse.parse("opt:near=7 dog", lex, o)[1].near == 7
    forced, _ = parse.parse("dog-cat~FD", parse.Lexicon())
    assert [x.kind for x in parse._leaves(forced) if x.dependency] == [1]
    assert parse.parse("", lex, o)[0] is None
    gone = parse.states(parse.parse("dog-cat~AND")[0], deleted={"cat"})
    assert {x.term for x in parse._leaves(gone)} == {"dog"}
    span = parse.Lexicon(spans={"new york": ["s1:nyc"]})
    assert "(OR_MAX ((s1:nyc 1 0 0 0 0 2)) (PROX 100 ((new" in sexp("new-york-bus~AND", span)


def test_requests():
    assert parse.request({"query": "x", "results": "all"}).results == 100_000_000
    assert parse.request({"logical_operator": "DPND_AND"}).force_dependency
    for bad in ({"start": "0"}, {"results": "0"}, {"wrong": "1"}, {"query": "a\x01"}):
        with pytest.raises(ValueError):
            parse.request(bad)


def test_api(spark, table):
    docs = spark.createDataFrame([(i, t, "src0") for i, t in table], "doc_id long, text string, source string")
    o = ix.word_occurrences(docs)
    page = api.search("a-b~AND", o, options=parse.Options(dependencies=False, results=5))
    want = {i for i, t in table if {"a", "b"} <= set(t.split())}
    rows = page.collect()
    assert len(rows) == 5 and {r["doc"] for r in rows} <= want and [r["final"] for r in rows] == sorted((r["final"] for r in rows), reverse=True)
    assert api.hit_count("a-b~AND", o, options=parse.Options(dependencies=False)).first()["hits"] == len(want)
    assert all(r["snippet"] for r in api.with_snippets(page, docs, "a-b~AND").collect())
    assert api.fetch(docs, [3, 4]).count() == 2


def test_merge_of_shards_is_the_index_of_all(occ):
    shards = [ix.postings(occ.where(F.col("doc") % 3 == k)) for k in range(3)]
    both = [sorted((r["term"], r["doc"], r["total"], tuple(r["positions"])) for r in x.collect()) for x in (ix.merge_indexes(*shards), ix.postings(occ))]
    assert both[0] == both[1]


def test_lookup_prunes_and_pushes(spark, occ, tmp_path):
    path = str(tmp_path / "index")
    ix.write_index(occ, path)
    found = ix.lookup(path, spark, ["a"])
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,a)" in plan
    assert found.count() == occ.where("term = 'a'").select("doc").distinct().count()


def test_query_meets_documents_in_one_exchange(occ):
    plan = hits(occ, Node("AND", [Leaf("a"), Node("PHRASE", [Leaf("b"), Leaf("c")])]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
