import pytest
from pyspark.sql import functions as F

from kelpline.operators import extraction as ex
from kelpline.operators import index as ix
from kelpline.operators import maintenance as mt
from kelpline.operators import results as rs
from kelpline.operators import snippets as sn
from kelpline.operators import standoff as so
from kelpline.sources import pages as pg
from kelpline.sources import standard_format as sf
from kelpline.streaming import ingest as st

XML = """<StandardFormat Url="http://a.example/x" OriginalEncoding="utf8" Time="2012-05-28"><Header><Title><RawString>river walk</RawString></Title></Header>
<Text><S Id="1" Paragraph="1" BlockType="maintext"><RawString>cats chase mice</RawString><Annotation>
<Chunk id="c0" head="c1"><Token id="t0" surf="cats" orig="cat" repname="" content_p="1"><synnode synid="s1:feline" score="0.99" wordid="t0"/></Token></Chunk>
<Chunk id="c1" head=""><Token id="t1" surf="chase" orig="chase" content_p="1"><Predicate nsubj="t0" dobj="t2"/></Token></Chunk>
<Chunk id="c2" head="c1"><Token id="t2" surf="mice" orig="mouse" content_p="1"/></Chunk>
</Annotation></S></Text></StandardFormat>"""


@pytest.fixture(scope="module")
def annotated(spark):
    return sf.parse(spark.createDataFrame([("1", XML)], "doc string, xml string"))


def test_terms_of_an_annotated_document(annotated):
    t = ex.token_rows(annotated)
    words = {(r["term"], r["pos"], r["score"]) for r in ex.word_terms(t).collect()}
    assert words == {("cats*", 0, 1.0), ("cat", 0, 1.0), ("s1:feline", 0, 0.99), ("chase*", 1, 1.0), ("chase", 1, 1.0), ("mice*", 2, 1.0), ("mouse", 2, 1.0)}
    deps = {(r["term"], r["pos"], r["feature"]) for r in ex.dependency_terms(t).collect()}
    assert deps == {("cats*->chase*", 0, 128 + 512), ("cat->chase", 0, 128 + 512), ("mice*->chase*", 2, 128 + 1024), ("mouse->chase", 2, 128 + 1024)}


def test_annotated_output(spark, annotated):
    again = sf.parse(sf.to_xml(annotated))
    assert again.select(F.col("sentences")[0]["chunks"][2]["tokens"][0]["orig"]).first()[0] == "mouse"
    assert sf.to_lines(annotated).first()["text"] == "* c0 c1\ncats cat\n* c1 \nchase chase\n* c2 c1\nmice mouse\nEOS"
    x = spark.createDataFrame([("1", XML), ("2", "<x/>")], "doc string, xml string")
    assert [(r["url"], r["title"]) for r in sf.url_and_title(x).collect()] == [("http://a.example/x", "river_walk"), ("none", "none")]
    assert [r["rawstring"] for r in sf.raw_strings(x).collect()] == ["river walk", "cats chase mice"]


def test_other_term_readers(spark):
    lines = spark.createDataFrame([("1", 1, "1\tCats\tcat"), ("1", 2, ""), ("1", 3, "1\tRan\trun")], "doc string, n int, line string")
    assert {(r["term"], r["pos"]) for r in ex.from_conll(lines).collect()} == {("cats*", 0), ("cat", 0), ("ran*", 1), ("run", 1)}
    lemma = spark.createDataFrame([("1", 1, "run ran")], "doc string, n int, line string")
    assert {r["term"] for r in ex.from_lemma_lines(lemma).collect()} == {"run", "ran*"}
    f = spark.createDataFrame([("1", 0, ["a", "b"])], "doc string, k int, forms array<string>")
    g = spark.createDataFrame([("1", 0, ["x", "y"])], "doc string, k int, forms array<string>")
    pairs = ex.alternative_pairs(ex.alternatives(f), ex.alternatives(g), ["doc", "k"]).collect()
    assert {r["term"] for r in pairs} == {"a->x", "a->y", "b->x", "b->y"} and all(r["score"] == 0.25 for r in pairs)


def test_dependency_rewrites(spark):
    e = spark.createDataFrame([("1", 1, "c0", "c1", "P"), ("1", 1, "c1", "c2", "P"), ("1", 1, "c2", "c3", "D"), ("1", 1, "c3", "", "D")], "doc string, sid int, chunk string, head string, kind string")
    assert {(r["chunk"], r["head"]) for r in ex.coordinated(e).collect()} == {("c0", "c3"), ("c1", "c3"), ("c2", "c3"), ("c3", "")}
    assert {(r["chunk"], r["head"], r["steps"]) for r in ex.transitive(e).collect()} >= {("c0", "c3", 3), ("c1", "c2", 1)}
    assert ex.transitive(e).count() == 6
    chain = spark.createDataFrame([("1", 1, f"c{i}", f"c{i + 1}" if i < 40 else "", "P") for i in range(41)], "doc string, sid int, chunk string, head string, kind string")
    assert {r["head"] for r in ex.coordinated(chain).where("head <> ''").collect()} == {"c40"}
    assert ex.transitive(chain).agg({"steps": "max"}).first()[0] == 40 and ex.transitive(chain).count() == 40 * 41 // 2
    deep = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "node string, head string")
    assert {r["head"] for r in ex.closure(deep).collect()} == {"n70"}
    h = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "t")], "node string, head string")
    assert {(r["node"], r["head"]) for r in ex.closure(h).collect()} == {("p", "t"), ("q", "t"), ("r", "t")}


def test_penalties_and_coordinates(spark):
    deps = spark.createDataFrame([("1", 0, "eat->apple"), ("1", 5, "eat->pear"), ("2", 0, "eat->apple")], "doc string, pos int, term string")
    co = spark.createDataFrame([("apple", "pear")], "term string, partner string")
    assert [(r["doc"], r["term"], r["score"]) for r in ex.penalties(deps, co).collect()] == [("2", "eat->pear$", -1.0)]
    known = spark.createDataFrame([("2", "eat->pear")], "doc string, term string")
    assert ex.penalties(deps, co, known).count() == 0
    sets = ex.coordinate_sets(spark.createDataFrame([("b/x", "a", 3), ("b", "c:1", 3)], "term string, partner string, df long")).collect()
    assert [(r["term"], r["coordinates"]) for r in sets] == [("b", [0, 2])]


def test_smoothing_stops_at_paragraphs(spark):
    for paras, want in (([0, 0, 0, 0], [2, 4, 2, 1]), ([0, 0, 1, 1], [2, 4, 0, 0])):
        s = spark.createDataFrame([(1, i, p, float(v)) for i, (p, v) in enumerate(zip(paras, [0, 4, 0, 0]))], "doc int, sid int, para int, score double")
        assert [r["smooth"] for r in sn.smoothed(s, 2).orderBy("sid").collect()] == want


def test_folding_titles():
    rows = [{"doc": 1, "title": "a", "score": 1.0}, {"doc": 2, "title": "a", "score": 0.97}, {"doc": 3, "title": "a", "score": 0.94}, {"doc": 4, "title": "b", "score": 0.93}]
    got = rs.fold_titles(rows)
    assert [(r["doc"], r["similar"]) for r in got] == [(1, [2]), (3, []), (4, [])]


def test_standoff_order_and_checks(spark):
    s = spark.createDataFrame([(1, i, *x) for i, x in enumerate([(0, 5, "b"), (0, 9, "a"), (2, 2, "e"), (0, 5, "a")])], "doc int, seq int, begin long, end long, tag string")
    got = so.ordered(s, ["a", "b", "e"]).orderBy("seq")
    assert [(r["begin"], r["end"], r["tag"]) for r in got.collect()] == [(0, 9, "a"), (0, 5, "a"), (0, 5, "b"), (2, 2, "e")]
    assert so.violations(s).count() > 0 and so.violations(got).count() == 0
    both = so.merge(["a", "b", "e"], s.where("tag = 'a'"), s.where("tag <> 'a'")).orderBy("seq")
    assert [r["tag"] for r in both.collect()] == ["a", "a", "b", "e"]
    lines = spark.createDataFrame([(1, 0, '0\t5\tnp\tid="x" k="y z"')], "doc int, seq int, line string")
    assert so.parse_lines(lines).first()["attrs"] == {"id": "x", "k": "y z"}


def test_marked_text(spark):
    marked = '<d>a <b x="1">bc</b>&lt;<e/>d</d>'
    text, spans = so.import_text(marked + "dropped")
    assert text == "a bc<d" and (2, 4, "b", 'x="1"') in spans and so.export_text(text, spans) == marked
    rows = so.import_documents(spark.createDataFrame([("1", marked), ("2", "<a>"), ("3", "</a>"), ("4", None)], "doc string, marked string")).collect()
    assert [r["error"] is None for r in rows] == [True, False, False, True]


def test_pages_and_crawls(spark, tmp_path):
    (tmp_path / "a.html").write_text("HTML http://a.example/p\nDate: Mon, 28 May 2012 00:00:00 GMT\n\n<title>x y</title><a href='no'>\x02</a>")
    (tmp_path / "b.html").write_text("<p>plain</p>")
    crawl = {r["path"][-6:]: r for r in pg.read_crawl(spark, str(tmp_path)).collect()}
    assert crawl["a.html"]["url"] == "http://a.example/p" and crawl["a.html"]["html"].startswith("<title>") and "\x02" not in crawl["a.html"]["html"]
    assert crawl["b.html"]["url"] is None and crawl["b.html"]["html"] == "<p>plain</p>"
    pages = spark.createDataFrame([(1, "http://a.example/x/", '<a href="../y">to y</a>'), (2, "http://a.example/y", "")], "page_id long, url string, html string")
    table = pg.link_table(pages)
    assert [(r["src_sid"], r["dst_sid"], r["anchor"]) for r in table.collect()] == [(1, 2, "to y")]
    assert {(r["doc"], r["term"], r["score"]) for r in ix.anchor_occurrences(table).collect()} == {(2, "to", 1.0), (2, "y", 1.0)}
    ids = pg.assign_ids(spark.createDataFrame([("b",), ("a",)], "path string")).orderBy("path").collect()
    assert [r["sid"] for r in ids] == ["0000000000", "0000000001"]


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.html", "B"), z.writestr("a.html", "A"), z.writestr("c.txt", "C")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    assert [(r["member"], r["html"]) for r in pg.unzip(files).collect()] == [("a.html", "A"), ("b.html", "B")]
    assert pg.unzip(files, 1).count() == 1


def test_upkeep(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sid string")
    assert sorted(r["sid"] for r in mt.latest_versions(ids("1-1", "1-10", "1-9", "2")).collect()) == ["1-10", "2"]
    assert [r["sid"] for r in mt.select_ids(ids("1-2", "3"), ids("1"), any_version=True).collect()] == ["1-2"]
    assert [r["sid"] for r in mt.live_ids(ids("1", "2", "3"), ids("2"), ids("3")).collect()] == ["1"]
    hosts = spark.createDataFrame([("b", "h1"), ("d", "h2")], "upper string, host string")
    exact = spark.createDataFrame([("a", "h9")], "sid string, host string")
    assert {r["sid"]: r["host"] for r in mt.host_of(ids("a", "c", "e"), hosts, exact).collect()} == {"a": "h9", "c": "h2", "e": "none"}
    files = spark.createDataFrame([("x",), ("y",)], "file string")
    done = spark.createDataFrame([("x", "success")], "file string, state string")
    assert [r["file"] for r in mt.unfinished(files, done).collect()] == ["y"]
    meta = spark.createDataFrame([(1, "a"), (1, "b")], "doc int, t string")
    assert [r["sid"] for r in mt.synthetic_ids(meta, "doc", "t").orderBy("t").collect()] == [-100000, -99998]


def test_text_index_round_trip(spark):
    lines = spark.createDataFrame([("s1:x 11:0.99@109#1446&0.99&16 12-1:1.98@164,176#1748&0.99&16,1868&0.99",)], "value string")
    rows = [(r["doc"], r["total"], r["sentences"], r["pos"], r["score"], r["feature"]) for r in ix.read_text_lines(lines).orderBy("pos").collect()]
    assert rows == [("11", 0.99, [109], 1446, 0.99, 16), ("12-1", 1.98, [164, 176], 1748, 0.99, 16), ("12-1", 1.98, [164, 176], 1868, 0.99, 0)]


def test_key_values(spark, tmp_path):
    (tmp_path / "kv.txt").write_text("b 2\na 1\nb 3\n")
    t = sf.read_key_values(spark, str(tmp_path / "kv.txt"))
    assert [(r["key"], r["value"]) for r in sf.sum_key_values(t).collect()] == [("a", 1.0), ("b", 5.0)]
    sf.write_key_values(t, str(tmp_path / "kv"))
    assert spark.read.parquet(str(tmp_path / "kv")).where("key = 'b'").count() == 2


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "src0"), (2, "b c", "src1")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    st.ingest(stream, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination(60)
    got = {(r["term"], r["doc"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2), ("c", 2)}
    events = spark.createDataFrame([("2024-01-01 00:00:10", "x"), ("2024-01-01 00:00:50", "x"), ("2024-01-01 00:01:10", "y")], "ts string, event_type string")
    events.write.parquet(str(tmp_path / "ev"))
    s = st.request_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = s.writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r["begin"])[11:16], r["event_type"], r["n"]) for r in spark.table("rates").collect()} == {("00:00", "x", 2), ("00:01", "y", 1)}
