"""Operators against brute force on small data with a hot key."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherewords import session
from wherewords.functions import scalars
from wherewords.operators import aggregates, clusters, features, joins, regions, rows, similarity
from wherewords.operators import windows, words
from wherewords.operators import topk
from wherewords.plans import geolocate as geolocate_plan
from wherewords.plans.geolocate import geolocate
from wherewords.sources.boxes import bbox_dimension
from wherewords.sources.files import read_tweets, write_table
from wherewords.sources.languages import stem_rule_dimension


@pytest.fixture(scope="module")
def skewed(spark):
    """1,000 rows; one key holds half of them."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(1000).select(
        F.col("id"), key.alias("key"), ((F.col("id") * 7919) % 1000).alias("order")
    )


def test_cap_per_key(skewed):
    capped = windows.cap_per_key(skewed, "key", 5, ["order", "id"], salts=4).collect()
    expected = {}
    for row in sorted(skewed.collect(), key=lambda r: (r["order"], r["id"])):
        expected.setdefault(row["key"], []).append(row["id"])
    assert {r["id"] for r in capped} == {i for ids in expected.values() for i in ids[:5]}


def test_row_ids_with_few_ranges(skewed):
    numbered = rows.with_row_id(skewed.filter("id % 3 = 1"), "id", buckets=5).orderBy("id").collect()
    assert [r["row_id"] for r in numbered] == list(range(len(numbered)))


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_exact_holdout(skewed, share):
    sample = rows.exact_holdout(skewed, "id", share)
    assert sample.count() == sample.select("id").distinct().count() == int(share * 1000)
    assert rows.complement(skewed, sample, "id").count() == 1000 - int(share * 1000)


def test_splits_are_disjoint_and_complete(skewed):
    for a, b in (rows.split(skewed, "id", 0.2), rows.half_split(skewed, "id", 111)):
        assert a.count() + b.count() == 1000
        assert a.join(b, "id").count() == 0


def test_mode_first_and_text_pieces(spark):
    df = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "y"), (3, "a", "y"), (4, "a", "x"), (5, "b", None), (6, "b", "z")],
        "id bigint, key string, value string",
    )
    modes = {r["key"]: r["value"] for r in aggregates.mode_first(df, "key", ["value"], "id").collect()}
    assert modes == {"a": "x", "b": "z"}
    pieces = aggregates.join_text(df, "key", ["value"], "id", chunk=2).orderBy("key", "piece").collect()
    joined = {}
    for row in pieces:
        joined.setdefault(row["key"], []).append(row["value"])
    assert " ".join(joined["a"]) == "x y y x"


def test_keep_frequent_is_strict(spark):
    df = spark.createDataFrame([("a",)] * 11 + [("b",)] * 10 + [(None,)] * 20, "key string")
    assert joins.keep_frequent(df, "key", 10).distinct().collect() == [("a",)]


def test_one_hot_of_many_values(spark):
    df = spark.range(1001).withColumn("s", F.concat(F.lit("o'`x"), F.col("id")))
    model = joins.one_hot_vector(df, "s", "flags")
    other = df.limit(3).withColumn("s", F.when(F.col("id") == 0, "unseen").otherwise(F.col("s")))
    flags = {r["id"]: r["flags"] for r in model.transform(df.limit(3).unionAll(other)).collect()}
    assert flags[1].size == 1001 and flags[1].numNonzeros() == 1 and flags[0].numNonzeros() == 0


def test_staged_tables_are_dropped(spark, tmp_path):
    path = tmp_path / "other"
    kept = session._staged.pop(spark.sparkContext.applicationId, [])
    session._staged[spark.sparkContext.applicationId] = [str(path)]
    spark.range(3).write.parquet(str(path))
    session.drop_staged(spark)
    session._staged[spark.sparkContext.applicationId] = kept
    assert not path.exists()


def test_row_ids_of_an_empty_table(skewed):
    assert rows.with_row_id(skewed.limit(0), "id").collect() == []
    assert rows.with_row_id(skewed, "id", buckets=1).agg(F.max("row_id")).first()[0] == 999


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_best_in_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id int, v array<double>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "key int, w array<double>")
    ranked = similarity.best_in_blocks(
        points, table, "id", "v", "key", "w", scalars.squared_distance, k=3, block_rows=block_rows
    ).collect()
    for row in ranked:
        distance = ((b - a[row["id"]]) ** 2).sum(axis=1)
        assert [r["key"] for r in row["ranked"]] == np.argsort(distance)[:3].tolist()


def test_stem_forms_agree(spark):
    """The expression and the rule table give the same stems."""
    tokens = ["rational", "ponies", "sing", "singing", "was", "s", "häuser", "zeitungen", "canciones"]
    df = spark.createDataFrame(
        [(lang, w) for lang in ("en", "de", "es", "eu", "xx") for w in tokens],
        "user_lang string, word string",
    )
    direct = {
        (r[0], r[1]): r[2]
        for r in df.select("user_lang", "word", words.stem("word", "user_lang")).collect()
    }
    table = words.stem_vocabulary(df, stem_rule_dimension(spark)).collect()
    assert {(r["lang"], r["word"]): r["stem"] for r in table} == direct
    assert direct["en", "ponies"] == "poni" and direct["xx", "ponies"] == "ponies"
    assert direct["en", "sing"] == "sing" and direct["en", "singing"] == "sing"


def test_stemming_is_compiled_and_done_once(spark, capsys):
    """HotSpot compiles no method of over 8000 bytes; a join on the term adds no test of it."""
    rows = [(1, "en", "The ponies #singing sang @you http://x/y ponies"), (2, None, "ponies"), (3, "de", None), (None, "en", "a is")]
    df = session.stage(spark.createDataFrame(rows, "tweet_id bigint, user_lang string, text string"), "messages")
    stops = session.stage(spark.createDataFrame([("en", "the")], "lang string, word string"), "stops")
    counts = words.message_term_counts(df, stops, "tweet_id")
    assert sorted((r["tweet_id"] or 0, r["term"], r["tf"]) for r in counts.collect()) == [
        (0, "is", 1), (1, "poni", 2), (1, "sang", 1), (1, "sing", 1), (1, "singing", 1), (2, "ponies", 1)
    ]
    joined = counts.join(session.stage(counts.select("term").distinct(), "terms"), "term")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    code = capsys.readouterr().out
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    assert "Project" in code and not any("Filter" in line and "CASE" in line for line in code.splitlines())


def test_crowded_cells(spark):
    """Nine tenths of the points in one cell, half of those at one spot: no key has many, and
    the same boxes are found."""
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-180, 180, 6000), rng.uniform(-90, 90, 6000)
    lon[:5400], lat[:5400] = rng.normal(7.0, 1.5, 5400), rng.normal(47.0, 1.5, 5400)
    lon[:2700], lat[:2700] = 8.5, 47.4
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))] + [(6000, None, 1.0)]
    points = session.stage(spark.createDataFrame(rows, "id int, lon double, lat double"), "points")
    boxes = bbox_dimension(spark)
    leaves = session.stage(regions.crowded_leaves(points.filter("id % 2 = 0"), 50), "leaves")
    for multi in ("all", "smallest"):
        plain = {tuple(r) for r in regions.tag_region(points, boxes, multi).select("id", "country").collect()}
        cut = regions.tag_region(points, boxes, multi, leaves=leaves).select("id", "country").collect()
        assert len(cut) == len(plain) and {tuple(r) for r in cut} == plain
    located, _ = regions._in_leaves(points, regions.box_cells(boxes), leaves, 20.0, 6)
    sizes = sorted(r["count"] for r in located.filter("lon IS NOT NULL").groupBy("_cell_lon", "_cell_lat", "_level", "_salt").count().collect())
    # The sample is half of the points, and some lie in cells that it has not seen.
    assert sizes[-1] <= 4 * 50 < 5400 / 20
    assert regions.crowded_leaves(points.limit(0), 5).count() == 0


def test_boxes(spark):
    boxes = bbox_dimension(spark)
    assert boxes.count() == boxes.select("country").distinct().count() == 174
    points = spark.createDataFrame([(1, 2.35, 48.86), (2, 0.0, -80.0)], "id int, lon double, lat double")
    every = {(r["id"], r["country"]) for r in regions.tag_region(points, boxes).collect()}
    edges = [tuple(r) for r in boxes.collect()]
    assert every == {
        (p["id"], b[1])
        for p in points.collect() for b in edges
        if b[2] <= p["lon"] <= b[4] and b[3] <= p["lat"] <= b[5]
    }
    first = {r["id"]: r["country"] for r in regions.tag_region(points, boxes, multi="smallest").collect()}
    assert first == {1: "France", 2: "Antarctica"}


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    texts = ['say "hi", you', "two\nlines", " padded ", "back\\slash"]
    df = spark.createDataFrame([(t, f"p{i}") for i, t in enumerate(texts)], ["text", "place country"])
    write_table(df.coalesce(1), str(tmp_path / "t"), "csv", encoding="ISO-8859-1")
    back = read_tweets(spark, [str(tmp_path / "t")]).orderBy("place_country").collect()
    assert [r["text"] for r in back] == texts
    assert back[0]["lon"] is None


def test_doc_coordinates_keep_distances(spark):
    docs = {"a": {"x": 1.0, "y": 2.0}, "b": {"y": 1.0, "z": 3.0}, "c": {"x": 1.0}, "d": {"w": 2.0}}
    weights = spark.createDataFrame(
        [(d, t, w) for d, terms in docs.items() for t, w in terms.items()],
        "doc_key string, term string, weight double",
    )
    placed = {r["doc_key"]: r["features"].toArray() for r in clusters.doc_coordinates(weights).collect()}
    for p in docs:
        for q in docs:
            terms = set(docs[p]) | set(docs[q])
            true = sum((docs[p].get(t, 0) - docs[q].get(t, 0)) ** 2 for t in terms)
            assert abs(((placed[p] - placed[q]) ** 2).sum() - true) < 1e-8


PROFILES = {
    "A": "red red blue sun", "B": "blue sea sea", "C": "red sea moon moon moon", "D": "ice snow",
}
QUERIES = {1: "red sun new", 2: "sea", 3: "nothing known", 4: "snow moon red", 5: ""}
CLUSTER = {"A": 0, "B": 0, "C": 0, "D": 1}
PREDICTED = {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


def brute_geolocate(scope):
    def weigh(counts, idf):
        raw = {t: c * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    best = {}
    for q, query in QUERIES.items():
        members = sorted(d for d in PROFILES if CLUSTER[d] == PREDICTED[q])
        corpus = [PROFILES[d] for d in (sorted(PROFILES) if scope == "global" else members)]
        if scope == "cluster":
            corpus.append(query)
        bags = [Counter(t.split()) for t in corpus]
        df = Counter(t for bag in bags for t in bag)
        idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
        mine = weigh(Counter(query.split()), idf)
        scores = []
        for d in members:
            other = weigh(Counter(PROFILES[d].split()), idf)
            scores.append((-round(sum(w * other.get(t, 0) for t, w in mine.items()), 6), d))
        best[q] = min(scores)
    return {q: (d, -s + 0.0) for q, (s, d) in best.items()}


@pytest.mark.parametrize("group_docs", [512, 2])
@pytest.mark.parametrize("scope", ["global", "cluster"])
def test_geolocate(spark, monkeypatch, scope, group_docs):
    monkeypatch.setattr(geolocate_plan, "GROUP_DOCS", group_docs)
    def counts(texts, key, kind):
        pairs = [(k, t, c) for k, v in texts.items() for t, c in Counter(v.split()).items()]
        return spark.createDataFrame(pairs, f"{key} {kind}, term string, tf bigint")

    profiles = spark.createDataFrame(
        [(d, c, float(i), -float(i)) for i, (d, c) in enumerate(CLUSTER.items())],
        "doc_key string, cluster int, lat double, lon double",
    )
    pred = spark.createDataFrame(list(PREDICTED.items()), "tweet_id bigint, cluster int")
    found = geolocate(
        pred, counts(QUERIES, "tweet_id", "bigint"), profiles, counts(PROFILES, "doc_key", "string"), scope,
        block_rows=1 if group_docs == 2 else 2000,
    ).collect()
    assert {r["tweet_id"]: (r["country"], r["score"]) for r in found} == brute_geolocate(scope)
    assert all(r["lat"] == -r["lon"] == list(CLUSTER).index(r["country"]) for r in found)


def test_tfidf_forms_agree(spark):
    tf = spark.createDataFrame(
        [("a", "x", 2), ("a", "y", 1), ("b", "y", 3)], "doc string, term string, tf bigint"
    )
    idf = features.idf_table(tf, "doc")
    short = {(r[0], r[1]): round(r[2], 12) for r in features.tfidf(tf, idf, "doc").collect()}
    long = {(r[0], r[1]): round(r[2], 12) for r in features.tfidf(tf, idf, "doc", short_docs=False).collect()}
    assert short == long and short["b", "y"] == 1.0


@pytest.mark.parametrize("group_docs,block_rows,k", [(512, 2000, 3), (4, 5, 3), (1, 1, 50)])
def test_nearest_sparse(spark, monkeypatch, group_docs, block_rows, k):
    """Blocks and groups of any size, ties, queries without a known term, fewer documents than k."""
    monkeypatch.setattr(topk, "GROUP_DOCS", group_docs)
    monkeypatch.setattr(topk, "CELLS", 8)
    rng = np.random.default_rng(k)
    corpus = rng.integers(0, 3, (10, 12)) * 0.5
    queries = rng.integers(0, 3, (17, 12)) * 0.25
    queries[3] = 0

    def long(matrix, name):
        return [(f"{name}{i}", f"t{j}", float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row) if x]

    asked = spark.createDataFrame(long(queries, "q") + [("q3", "new", 1.0)], "q string, term string, weight double")
    docs = spark.createDataFrame(long(corpus, "d"), "d string, term string, weight double")
    keys = spark.createDataFrame([(f"q{i}",) for i in range(17)] + [("q99",)], "q string")
    found = {(r["q"], r["rank"]): (r["d"], r["score"]) for r in topk.nearest_sparse(asked, docs, "q", "d", k, 6, keys, block_rows).collect()}
    names = [f"d{i}" for i in range(10) if corpus[i].any()]
    scores = {f"q{i}": {f"d{j}": round(float(queries[i] @ corpus[j]), 6) for j in range(10) if corpus[j].any()} for i in range(17)}
    scores["q99"] = {d: 0.0 for d in names}
    expected = {
        (q, n + 1): (d, s) for q, own in scores.items() for n, (d, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k])
    }
    assert found == expected


def test_places_by_their_rarest_word(spark):
    """Names of one to six words, overlapping and repeated; words that are in no text."""
    texts = {
        1: "the bay of the great white bear lies north of new york new york", 2: "new york", 3: "york new", 4: "",
        5: "bay of the great white", 6: "great great white bear", 7: None,
    }
    names = ["new york", "york", "bay of the great white bear", "great white", "white bear", "nowhere", "new nowhere", "the", ""]
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    gazetteer = spark.createDataFrame([(n,) for n in [*names, "york", None]], "place string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    found = {(r["id"], r["place"]): r["n"] for r in regions.extract_places(df, gazetteer, "id", words).collect()}
    expected = Counter(
        (i, name) for i, text in texts.items() for name in names if name
        for at in range(len((text or "").split())) if (text or "").split()[at : at + len(name.split())] == name.split()
    )
    assert found == dict(expected)
    short = regions.extract_places(df, gazetteer, "id", words, max_words=1).collect()
    assert {r["place"] for r in short} == {"york", "the"}


def test_texts_are_dealt_to_tasks_by_their_size(spark, folder, monkeypatch, capsys):
    """However few shuffle partitions there are, each split of the documents is many tasks."""
    from checks import base

    splits = base.table(spark, folder, "documents").rdd.getNumPartitions()
    monkeypatch.setattr(base, "TASKS_PER_SPLIT", 50)
    base.tweets(spark, folder).explain("extended")
    assert f", {50 * splits}" in next(line for line in capsys.readouterr().out.splitlines() if "RepartitionByExpression" in line)
