"""Text functions against plain Python on an edge table."""

import pytest
from pyspark.sql import functions as F

from wherewords.functions import scalars, text

# Text, clean text, hashtags, mentions, words for vectors.
CASES = [
    ("@foo_bar hi @b @ab1 x@no .@no2 @@yes (@Ok)", "bar hi x", "", ["foo", "ab1", "yes", "Ok"],
     ["foo_bar", "hi", "ab1", "no", "no2", "yes", "ok"]),
    ("café http://t.co/x_y #a #b# ## #a, über_http://q.z/1 tab\tx", "caf a b a tab x", ", a, a,, b", [],
     ["café", "http", "co", "x_y", "über_http", "tab"]),
    ("日本 café://x", "", "", [], ["日本", "café"]),
    ("éabc://x/y rest", "rest", "", [], ["éabc", "rest"]),
    ("@user_name://x done", "done", "", ["user"], ["user_name", "done"]),
    ("http:// not-a-url a://b c", "http not a url c", "", [], ["http", "not", "url"]),
    ("x\u00a0y\u3000#z \u2028#z q\x1f#w", "x y z z q w", "w, z", [], []),
    ("a1b2 #tag#tag2 #ÄÖ@me @me@you", "a1b2 tag tag2", "tag#tag2, ÄÖ@me", ["me", "me"],
     ["a1b2", "tag", "tag2", "äö", "me", "me", "you"]),
    ("  ", "", "", [], []),
    ("", "", "", [], []),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, case[0]) for i, case in enumerate(CASES)], "id int, text string")


def column(edges, expression):
    return [r[0] for r in edges.orderBy("id").select(expression).collect()]


@pytest.mark.parametrize(
    "function,place",
    [(text.clean_text, 1), (text.hashtags, 2), (text.mention_list, 3), (text.vector_tokens, 4)],
)
def test_edge_cases(edges, function, place):
    assert column(edges, function(F.col("text"))) == [case[place] for case in CASES]


def test_tokens(edges):
    found = column(edges, text.tokens(F.col("text")))
    assert found[5] == ["http://", "not-a-url", "a://b", "c"] and found[6] == ["x", "y", "#z", "#z", "q", "#w"]
    assert found[8] == found[9] == []


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    grams = [r[0] for r in df.select(text.ngrams(F.col("w"), 3)).collect()]
    assert grams == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_tweet_tokens(spark):
    df = spark.createDataFrame([("@me Sooooo don't #Tag! http://x.y/z well-known",)], "t string")
    tokens = df.select(text.tweet_tokens(F.col("t"))).first()[0]
    assert tokens == ["sooo", "don't", "#tag", "!", "http://x.y/z", "well-known"]


def test_seconds_of_day_text(spark):
    df = spark.createDataFrame([("2017-12-01 13:14:15",), ("nothing",)], "t string")
    values = [r[0] for r in df.select(scalars.seconds_of_day_text(F.col("t"))).collect()]
    assert values == [13 * 3600 + 14 * 60 + 15, None]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = df.select(
        text.clean_text(F.col("text")).alias("a"), text.hashtags(F.col("text")).alias("b"),
        text.null_text(F.col("text")).alias("c"), text.null_text(F.col("text"), True).alias("d"),
    ).first()
    assert tuple(row) == (None, None, "", "nan")


def test_plain_tokens_and_tags_are_those_of_the_patterns(spark):
    """Texts of ASCII words take a short way, and tags are picked without a split."""
    rows = ["", "a  b", "Aaaab 11111 c", "a\n", "a b\n", "x @user y", "é a", "a-b c's", " #a#b x#y #c\u00a0#d \U0001f600#e #", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", text.HANDLE, "$1 "), r"(.)\1{2,}", "$1$1$1")
    by_pattern = F.regexp_extract_all(F.lower(plain), F.lit(text.TWEET_TOKEN), 0)
    tags = F.filter(text.tokens(F.col("t")), lambda t: t.startswith("#"))
    by_split = F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.btrim(t, F.lit("#")))))
    for r in df.select(text.tweet_tokens(F.col("t")), by_pattern, text.hashtag_set(F.col("t")), by_split).collect():
        assert r[0] == r[1] and r[2] == r[3]


def test_pairs_of_words_with_nulls(spark):
    df = spark.createDataFrame([(["a", None, "b", "c"],), (["a"],), ([],), (None,)], "w array<string>")
    found = [r[0] for r in df.select(text.bigrams(F.col("w"))).collect()]
    assert found == [["a", "b", "b c"], [], [], []]


def test_single_blanks_of_every_white_space(spark):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}a{chr(c)}{chr(c)}b {chr(c)}c{chr(c)} d{chr(c)}" for c in points] + [" a  b c \n d\n", "", "   ", "a b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    plain = F.regexp_replace("t", f"[{text.SPACE}]+", " ")
    assert frame.filter(~text.single_blanks(F.col("t")).eqNullSafe(plain)).count() == 0
    assert frame.filter(plain != F.col("t")).count() > 20


def test_clean_words_of_every_letter(spark):
    ranges = text.CLEAN_WORD.replace(r"\p{Alnum}", "[0-9A-Za-z]")
    texts = [f"a{chr(c)}b1 {chr(c)}http://x{chr(c)} @u{chr(c)}v" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    plain = F.filter(F.regexp_extract_all("t", F.lit(ranges), 1), lambda w: w != "")
    assert frame.filter(~text.clean_words(F.col("t")).eqNullSafe(plain)).count() == 0
