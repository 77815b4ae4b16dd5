"""What the queries exchange and how their work grows."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kelpline.operators import extraction as ex
from kelpline.operators import index as ix
from kelpline.plans.execute import hits
from kelpline.plans.tree import Leaf, Node

TEXTS = [(1, "b a b\nc a", "src1"), (2, "a\n\nb c b a", "src2"), (3, "", "src3"), (4, None, "src3"), (5, "c", "src9")]


def table(spark, path, rows=TEXTS):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", params=[TEXTS, TEXTS + [(2, "b d", "src2")]], ids=["own ids", "repeated id"])
def sf(spark, request, tmp_path_factory):
    return table(spark, tmp_path_factory.mktemp("sf"), request.param), request.param


def words(rows):
    return [(d, p, w) for d, t, _ in rows for p, w in enumerate((t or "").split())]


def pairs(rows):
    return [(d, f"{a}->{b}") for d, t, _ in rows for x in (t or "").split("\n") for a, b in zip(x.split(), x.split()[1:])]


def test_postings_and_lines(spark, sf):
    path, rows = sf
    got = entry.queries()["index_postings"](spark, path)
    want = Counter((w, d) for d, _, w in words(rows))
    assert {(r["term"], r["doc"]): r["total"] for r in got.collect()} == want
    lines = {r["term"]: r["line"] for r in entry.queries()["index_text_lines"](spark, path).collect()}
    assert set(lines) == {w for _, _, w in words(rows)} and lines["c"].startswith("c 1:1.00@0#3&1 2:1.00@0#2&1")
    if rows is TEXTS:
        assert "hashpartitioning(index_type" not in plan(got)
        assert {r["doc"]: r["positions"] for r in got.where("term = 'b'").collect()} == {1: [0, 2], 2: [1, 3]}
        assert "hashpartitioning(term#" in (p := plan(entry.queries()["index_text_lines"](spark, path))) and p.count("Exchange hashpartitioning") == 1


def test_counts_hold_no_document_in_an_exchange(spark, sf):
    path, rows = sf
    got = entry.queries()["index_dependencies"](spark, path)
    n, df = Counter(t for _, t in pairs(rows)), Counter(t for _, t in set(pairs(rows)))
    assert {r["term"]: (r["n"], r["df"]) for r in got.collect()} == {t: (n[t], df[t]) for t in n}
    cut, own = entry.queries()["index_frequency_cut"](spark, path), entry.queries()["index_document_frequency"](spark, path)
    assert {r["term"] for r in cut.collect()} == {t for t in df if df[t] > 2}
    assert {r["term"]: r["df"] for r in own.collect()} == Counter(w for _, w in {(d, w) for d, _, w in words(rows)})
    if rows is TEXTS:
        assert all(plan(x).count("Exchange hashpartitioning") == 1 for x in (got, cut, own))


def test_hygiene_counts_once(spark, tmp_path):
    path = table(spark, tmp_path, [(i, "often rare%d" % i, "src1") for i in range(6)])
    got = entry.queries()["index_term_hygiene"](spark, path)
    assert [(r["term"], r["df"]) for r in got.collect()] == [("often", 6)]
    # what is asked of a term is asked of its count, above the exchange
    assert plan(got).count("array_distinct") == plan(got).count("partial_count") and "NOT Contains" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_positions_of_dependencies(spark):
    d = spark.createDataFrame([(1, "a b\nc\n\nd e f", "src1")], "doc_id long, text string, source string")
    assert [(r["pos"], r["term"], r["len"]) for r in ix.dependency_occurrences(d).orderBy("pos").collect()] == [(0, "a->b", 6), (3, "d->e", 6), (4, "e->f", 6)]


def test_penalties_meet_partners_alone(spark):
    deps = spark.createDataFrame([("1", 0, "x->a"), ("1", 1, "x->z"), ("2", 0, "x->a"), ("2", 1, "x->b")], "doc string, pos int, term string")
    got = ex.penalties(deps, F.broadcast(spark.createDataFrame([("a", "b")], "term string, partner string")))
    assert [(r["doc"], r["term"]) for r in got.collect()] == [("1", "x->b$")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("op", ["PROX", "ORDERED_PROX", "PHRASE"])
def test_near_in_long_documents(spark, op):
    terms, rng = ["a", "b", "c"], random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))), "src1") for i in range(60)]

    def holds(text):
        at = [[p for p, w in enumerate(text.split()) if w == t] for t in terms]
        trios = [(x, y, z) for x in at[0] for y in at[1] for z in at[2]]
        return any({"PROX": max(t) - min(t) <= 3, "ORDERED_PROX": t[0] <= t[1] <= t[2] <= t[0] + 3, "PHRASE": t == (t[0], t[0] + 1, t[0] + 2)}[op] for t in trios)

    want = {i for i, t, _ in rows if holds(t)}
    # every word often, and no two of them near
    rows.append((99, " ".join(["a"] * 4000 + ["d"] * 200 + ["c"] * 4000 + ["d"] * 200 + ["b"] * 4000), "src1"))
    began = time.time()
    found = hits(ix.Corpus(spark.createDataFrame(rows, "doc_id long, text string, source string")), Node(op, [Leaf(t) for t in terms], 3))
    assert {r["doc"] for r in found.select("doc").collect()} == want and time.time() - began < 30


@pytest.mark.parametrize("query", ["extract_words", "extract_dependencies"])
def test_terms_are_found_within_the_row(spark, tmp_path, query):
    path = table(spark, tmp_path)
    got = entry.queries()[query](spark, path)
    p = plan(got)
    assert p.count("Exchange hashpartitioning") == 1 and "Window" not in p and "Join" not in p
    one = Counter(w for _, _, w in words(TEXTS)) if query == "extract_words" else Counter(t for _, t in pairs(TEXTS))
    assert {r["term"]: r["n"] for r in got.where("NOT contains(term, '*')").collect()} == one
