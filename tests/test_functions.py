import math

import pytest
from pyspark.sql import functions as F

from kelpline.functions import scoring as sc
from kelpline.functions import text as tx

N, AVG, DF = 100132750.0, 907.0, 3.0
GOLDEN = [(176, 22.6443, 16.8055), (245, 21.9826, 16.0798), (291, 21.5626, 15.6299), (238, None, 16.1506), (334, None, 15.2315), (1045, None, 10.7153)]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("length,basic,synonym", GOLDEN)
def test_bm25_reaches_the_published_scores(spark, length, basic, synonym):
    for f, want in ((1.0, basic), (0.495, synonym)):
        if want is not None:
            got = one(spark, sc.bm25(F.lit(f), F.lit(length), F.lit(N), F.lit(AVG), F.lit(DF)))
            assert got == pytest.approx(want, abs=2e-3)


def test_final_scores_with_the_older_constants(spark):
    w = sc.Weights(strict_bonus=100, text_share=0.9)
    got = one(spark, sc.final_score(F.lit(22.6443), F.lit(True), F.lit(False), F.lit(0.0), w))
    assert got == pytest.approx(110.38, abs=1e-2)


def test_legacy_scores(spark):
    assert one(spark, sc.legacy_bm25(F.lit(1.0), F.lit(907), F.lit(N), F.lit(AVG), F.lit(-1.0))) == 0
    assert one(spark, sc.legacy_bm25(F.lit(0.0), F.lit(907), F.lit(N), F.lit(AVG), F.lit(3.0))) == -1
    assert one(spark, sc.distance_bonus(F.lit(6))) == pytest.approx(0.8)
    assert one(spark, sc.distance_bonus(F.lit(30))) == 0 == one(spark, sc.distance_bonus(F.lit(-1)))
    null = F.lit(None).cast("double")
    assert one(spark, sc.legacy_final(F.lit(1.0), null, null, null, F.lit(0.5))) == 1.5
    assert one(spark, sc.legacy_final(F.lit(1.0), null, F.lit(2.0), null, F.lit(0.5))) == 3.0
    assert one(spark, sc.sentence_score(F.lit(2), F.lit(3), F.lit(10))) == pytest.approx(6 * (math.log(10) + 1))
    assert sc.per_shard_results(50, 4) == 50 and sc.per_shard_results(10000, 4) == 3751


def test_weights_of_occurrences(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, sc.occurrence_weight(f, f, f, t, f)) == 0.9
    assert one(spark, sc.occurrence_weight(t, f, f, t, f)) == 1.0
    assert one(spark, sc.occurrence_weight(f, t, f, f, t)) == pytest.approx(0.95)
    assert one(spark, sc.damping(t, t)) == 0.18 and one(spark, sc.damping(t, f)) == 0.15 and one(spark, sc.damping(f, f)) == 1


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: tx.strip_readings(F.lit("京大/きょうだい+s12:x/y")), "京大+s12:x/y"),
        (lambda: tx.strip_all_readings(F.lit("京大/きょうだい+s12:x/y")), "京大+s12:x"),
        (lambda: tx.strip_features(F.lit("行く<可能><尊敬><可能>")), "行く<可能>"),
        (lambda: tx.narrow(F.lit("ＡＢ　１")), "AB 1"),
        (lambda: tx.widen_upper(F.lit("ab")), "ＡＢ"),
        (lambda: tx.short_title(F.lit("a_b" + "c" * 60)), "a b" + "c" * 47 + "..."),
        (lambda: tx.unescape_basic(F.lit("&amp;lt; &lt;b&gt;")), "&lt; <b>"),
        (lambda: tx.normalise_url(F.lit("http://www2.a.example/b/c12/index.html")), "A.EXAMPLE/B/C0"),
        (lambda: tx.normalise_url(F.lit("http://a.example/b/c7/")), "A.EXAMPLE/B/C0"),
        (lambda: tx.sid_path(F.lit("0123456789")), "0123/012345"),
        (lambda: tx.strip_version(F.lit("0123456789-12")), "0123456789"),
        (lambda: tx.ects_normal(F.lit("犬/いぬ:1")), "犬"),
        (lambda: tx.query_key(F.lit("a b%")), "a+b@25"),
        (lambda: tx.highlight(F.lit("ab abc"), ["ab", "abc"]), '<span class="hit0">ab</span> <span class="hit1"><span class="hit0">ab</span>c</span>'),
    ],
)
def test_strings(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize("feature,keep", [(1, True), (128, True), (256, False)])
def test_masks(spark, feature, keep):
    assert one(spark, tx.mask_match(F.lit(feature).cast("long"), F.lit(129).cast("long"))) is keep
    assert one(spark, tx.mask_match(F.lit(feature).cast("long"), F.lit(0).cast("long"))) is True


def test_python_functions(spark):
    df = spark.createDataFrame([("http://a.example/x/y", "../z", "<b>abc</b> d&eacute;f")], "u string, l string, h string")
    r = df.select(tx.resolve_url("u", "l").alias("r"), tx.unescape_html("h").alias("e"), tx.truncate_html(2)("h").alias("t")).first()
    assert r["r"] == "http://a.example/z" and r["e"] == "<b>abc</b> déf" and r["t"] == "<b>ab</b>"


def test_cache_keys_ignore_order(spark):
    a, b = (one(spark, tx.cache_key(F.lit("q"), F.create_map(*[F.lit(x) for x in kv]))) for kv in (("a", "1", "b", "2"), ("b", "2", "a", "1")))
    assert a == b
