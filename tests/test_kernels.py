"""Literal cases for the kernels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amberlode.functions import facts as FF
from amberlode.functions import similarity as S
from amberlode.functions import text as T
from amberlode.functions import urls as U
from amberlode.operators import pipeline as P


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_spellings_share_a_compact_key(spark):
    fa = ["بندرعباس", "بندر عباس", "بندر‌عباس", "بَندَر عبّاس"]
    en = ["Bandar Abbas", "Bandar-e Abbas", "Bandar-e ‘Abbās"]
    assert set(column(spark, fa, T.compact)) == {"بندرعباس"}
    assert set(column(spark, en, T.compact)) == {"bandarabbas"}


def test_letters_and_digits(spark):
    assert column(spark, ["ميناب", "كشتي", "۱۳۵۵", "١٣٥٥", "می‌رود", None, ""], T.normalize) == ["میناب", "کشتی", "1355", "1355", "می رود", "", ""]


def test_normalize_is_idempotent(spark):
    texts = ["Bandar-e Abbas", "Ça va? É!", "بَندَر عبّاس", "a e b ye c", "x  y"]
    once = column(spark, texts, T.normalize)
    assert column(spark, once, T.normalize) == once


def test_script(spark):
    assert column(spark, ["قشم", "Qeshm", "123"], T.script) == ["Arab", "Latn", None]


def test_similarity(spark):
    df = spark.createDataFrame([("bandarabbas", "bandarabbas"), ("bandarabbas", "bandarabas"), ("qeshm", "minab"), ("ab", "ac")], "a string, b string")
    same, close, far, short = [r[0] for r in df.select(S.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert same == 1.0 and close > 0.8 and far < 0.5 and short < 0.85


@settings(max_examples=100)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_is_in_range(a, b):
    x = S.jaro_winkler_score(a, b)
    assert 0 <= x <= 1 + 1e-9 and (x == 1.0) >= (a == b != "")


def test_jaro_winkler_of_known_pairs():
    """Published values, and names that are empty."""
    known = {("martha", "marhta"): 0.9611, ("dixon", "dicksonx"): 0.8133, ("dwayne", "duane"): 0.84, ("crate", "trace"): 0.7333, ("abc", "xyz"): 0.0, ("", ""): 0.0, ("", "a"): 0.0, ("ab", "ab"): 1.0}
    assert {k: round(S.jaro_winkler_score(*k), 4) for k in known} == known


def test_name_similarity_is_the_stronger_measure(spark):
    pairs = [("", ""), ("", "abc"), ("martha", "marhta"), ("abcdefgh", "abcdefgx"), ("ab", "abx"), ("minab", "minab")]
    got = [round(r[0], 4) for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(S.name_similarity(F.col("a"), F.col("b"))).collect()]

    def grams(x):
        p = f"  {x} "
        return {p[i : i + 3] for i in range(len(p) - 2)} if x else set()

    want = []
    for a, b in pairs:
        x, y = grams(a), grams(b)
        s = max(0.95 * S.jaro_winkler_score(a, b), 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0)
        want.append(1.0 if a == b else round(s * (0.85 if min(len(a), len(b)) < 4 else 1), 4))
    assert got == want


def test_haversine(spark):
    km = spark.range(1).select(S.haversine_km(F.lit(27.0), F.lit(56.0), F.lit(28.0), F.lit(56.0))).first()[0]
    assert km == pytest.approx(111.2, abs=0.5)


def test_numbers_and_values(spark):
    assert column(spark, ["۱۲٬۳۴۵", "1,5", "x", "2٫5"], T.clean_number) == [12345.0, 15.0, None, 2.5]
    year = column(spark, ["1890", "۱۸۹۰"], lambda v: FF.value_hash(F.lit("year"), v))
    assert year[0] == year[1]
    assert column(spark, ["unknown", " UNKNOWN ", None], lambda v: FF.value_normalized(F.lit("year"), v)) == ["unknown"] * 3
    assert column(spark, ["2.50", "-3"], lambda v: FF.value_normalized(F.lit("decimal"), v)) == ["2.5", "-3"]


def test_urls(spark):
    got = column(spark, ["HTTP://Ex.org:80/a/?utm_x=1&b=2&a=1#f", "https://ex.org/", "//Ex.org/p"], U.canonical_url)
    assert got == ["http://ex.org/a?a=1&b=2", "https://ex.org", "https://ex.org/p"]
    assert column(spark, ["cc by-sa 4.0", "cc by 4.0", "cc0", ""], U.license_of) == ["cc_by_sa", "cc_by", "cc0", "unknown"]


def test_robots_longest_match_wins(spark):
    pages = spark.createDataFrame([(1, "/w/x"), (2, "/w/open/x"), (3, "/")], "page_id int, path string")
    got = {r.page_id: r.allowed for r in P.robots_allowed(pages, [("/w/", False), ("/w/open", True)]).collect()}
    assert got == {1: False, 2: True, 3: True}


def chunked(spark, text, size, overlap):
    return [tuple(c) for c in spark.createDataFrame([(text,)], "text string").select(P.split_chunks(F.col("text"), size, overlap)).first()[0]]


def test_chunks_overlap_and_stay_bounded(spark):
    pages = "A sentence of some length. " * 20 + "\f" + "Second page has enough text to stay."
    out = chunked(spark, pages, 200, 20)
    assert len(out) > 1 and out[-1][0] == 2 and all(len(c) <= 260 for _, c in out)
    assert chunked(spark, "short", 200, 20) == [] == chunked(spark, None, 200, 20)


def test_chunks_of_paragraphs_and_long_paragraphs(spark):
    a, b, c = "a" * 60, "b" * 30, "0123456789" * 25
    two = [(1, f"{a}\n\n"), (1, f"{'a' * 8}\n\n\n\n{b}")]
    assert chunked(spark, f"  {a}\n \t\n{b}  ", 80, 10) == two
    # 250 characters, windows of 100 that overlap by 20: at 0 and 80, and a rest of 90 from 160
    assert chunked(spark, c, 100, 20) == [(1, c[:100]), (1, c[80:180]), (1, c[160:])]
    # what was pending is cut to its tail and stands before the first window
    assert chunked(spark, f"{b}\n\n{c}", 100, 20) == [(1, f"{b}\n\n"), (1, f"{'b' * 18}\n\n\n\n{c[:100]}"), (1, c[80:180]), (1, c[160:])]
    assert chunked(spark, f"{b}\n\nx\n\ny", 100, 20) == [(1, f"{b}\n\nx\n\ny")]
    assert chunked(spark, f"x\f\f{a}  {b}", 100, 0) == [(3, f"{a} {b}")]
    assert chunked(spark, "é🙂" * 60, 100, 20) == [(1, "é🙂" * 50), (1, "é🙂" * 20)]


def test_html_text_prefers_the_article():
    assert P.text_of_html("<body><nav>x</nav><p>out</p><article><p>a &amp; b</p><p>c</p></article></body>") == "a & b\nc"


def test_pairs(spark):
    assert column(spark, ["a=x y b=z"], lambda v: P.split_pairs(v)) == [{"a": "x y", "b": "z"}]
