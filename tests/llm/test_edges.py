"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from wherewords.llm import (
    decontaminate, exact_dedup, jaccard_join, language_model, line_dedup, packing, secret_scan, token_files, toxicity,
    url_filter,
)
from wherewords.llm.encode import PieceEncoder, read_tokenizer
from wherewords.session import stage, staged_path
from tests.llm.conftest import HOT


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, HOT), (1, HOT), (2, None), (3, "one, TWO!"), (None, "w5 w6 w7"), (4, "...")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def by_key(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def test_exact_groups(odd_docs, no_docs):
    rows = exact_dedup.exact_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    empty = hashlib.sha256(b"").hexdigest()
    # The text of white space has the most code points of the empty ones.
    assert {found[k]["keep_id"] for k in (1, 2, 3)} == {3} and found[1]["text_sha256"] == empty
    assert found[1]["group_size"] == 4
    twice = [r for r in rows if r["doc_id"] == 6]
    assert sorted(r["kept"] for r in twice) == [False, True]
    assert found[11]["keep_id"] == 10 and found[11]["group_size"] == 2
    assert exact_dedup.exact_groups(no_docs).count() == 0


@pytest.mark.parametrize("leaves,fan_in", [(1, 2), (5, 2), (13, 3), (20, 8)])
def test_tree_merge_any_shape(spark, leaves, fan_in):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 37).alias("text"))
    rows = exact_dedup.exact_groups(stage(docs.repartition(leaves), "docs"), fan_in=fan_in).collect()
    assert len(rows) == 400 and all(r["keep_id"] == r["doc_id"] % 37 for r in rows)
    assert sum(r["kept"] for r in rows) == 37


def test_near_duplicates(odd_docs, no_docs):
    rows = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [found[k]["n_shingles"] for k in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 4]
    assert found[2]["component_id"] == 2 and found[5]["component_id"] == 4 and found[11]["component_id"] == 10
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["n_shingles"]] == [6]
    assert jaccard_join.near_duplicates(no_docs).count() == 0
    kept = jaccard_join.one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 6, 7, 8, 9, 10, 12, 13]


def test_large_near_copies_are_one_component(spark):
    """Each document differs from the others in one word of its own: no pair is special."""
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"own{i}", *base[i % 200 + 1 :]])) for i in range(300)]
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "copies")
    assert {r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()} == {0}


def test_contamination(odd_docs, no_docs, benchmark):
    rows = decontaminate.contamination(odd_docs, benchmark).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (found[1]["n_words"], found[1]["contaminated"]) == (0, False)
    assert (found[4]["n_hit"], found[4]["n_items"], found[4]["contaminated"]) == (2, 1, True)
    assert found[8]["n_hit"] == len(HOT.split()) and found[8]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    # Three of 3,000 words: found, but no contamination. The item without an id counts as none.
    assert (found[10]["n_hit"], found[10]["contaminated"]) == (3, False)
    kept = decontaminate.without_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert {4, 5, 7, 8, 9}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert decontaminate.contamination(odd_docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_lines(odd_docs, no_docs):
    found = by_key(line_dedup.line_report(odd_docs))
    assert [found[k]["n_lines"] for k in (1, 2, 3, 7)] == [0, 1, 2, 2]
    assert [found[k]["dropped"] for k in (7, 8, 9)] == [[], [0], [0]]
    assert line_dedup.line_report(no_docs).count() == 0
    left = line_dedup.without_recurring_lines(odd_docs)
    assert left.columns == odd_docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[8] == "other line here" and texts[7].startswith(HOT)


def test_lines_with_a_variable_field(spark):
    lines = ["order 17 shipped to alice from the main depot today", "order 4 shipped to bob from the main depot today",
             "order 99 shipped to carol from the main depot today", "order 5 was lost by dave at the harbour last night"]
    docs = stage(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"), "orders")
    found = by_key(line_dedup.line_report(docs))
    assert [found[k]["n_dropped"] for k in range(4)] == [0, 1, 1, 0]


def test_toxicity_without_labels(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(6, None), (7, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_docs, labels)
    assert model is toxicity.UNKNOWN
    assert all(0 <= r["score"] < 0.5 for r in toxicity.scores(odd_docs, model).collect())
    assert toxicity.without_toxic(odd_docs, model).count() == odd_docs.count()
    assert toxicity.scores(no_docs, model).count() == 0


def test_language_model(odd_docs, no_docs):
    scored = language_model.score_texts(odd_docs, F.lit(True)).collect()
    assert len(scored) == odd_docs.count()
    found = {r["doc_id"]: r for r in scored if r["doc_id"] is not None}
    assert (found[1]["n_tokens"], found[1]["n_known"]) == (1, 1) and found[10]["n_tokens"] == 3001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in scored)
    assert language_model.score_texts(no_docs, F.lit(True)).count() == 0
    unknown = language_model.score_texts(odd_docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in unknown)


def test_token_files(odd_docs, no_docs, spark):
    tokenizer = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for docs, encoding in ((odd_docs, "delta"), (no_docs, "dictionary")):
        path = staged_path(spark, "ids")
        token_files.write_token_files(docs, path, tokenizer, 0, encoding=encoding)
        rows = token_files.token_digests(spark, path).orderBy("start").collect()
        assert len(rows) == docs.count()
        assert [r["start"] for r in rows] == list(np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1])
    alone = zlib.crc32(np.array([0], "<u4").tobytes())
    path = staged_path(spark, "ids")
    token_files.write_token_files(odd_docs, path, tokenizer, 0)
    found = by_key(token_files.token_digests(spark, path), "key")
    assert (found[1]["n_tokens"], found[1]["ids_crc32"]) == (1, alone)
    assert token_files.token_metadata(spark, path).count() == odd_docs.count()


def test_packing(odd_docs, no_docs):
    tokenizer = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack_documents(odd_docs, tokenizer, 2, sequence_tokens=64).collect()
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in sequences.values())
    own = {}
    for p in pieces:
        own.setdefault(p["doc_id"], []).append(p)
    assert {1, 2, 3, None} <= set(own) and own[1][0]["doc_tokens"] == 1
    assert sum(p["length"] for p in own[10]) == own[10][0]["doc_tokens"]
    assert packing.pack_documents(no_docs, tokenizer, 2).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    encoder = PieceEncoder(read_tokenizer(public_tokenizers.path(name)))
    rng = np.random.default_rng(5)
    alphabet = [*"ab1é日 \n\t.,!'s", "  ", "\n\n", "..", ".,", " .", "<|endoftext|>", "İ", "\0", "\x1c", "\xa0", "word", "The", "'s", "́", "½"]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 15))) for _ in range(40)]
        ids, lengths = encoder.encode(texts, 9)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for text, part in zip(texts, parts, strict=True):
            assert part.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 9], text


def test_secrets(odd_docs, no_docs, spark):
    rows = [
        (i, f"intro words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more", "src/app") for i in range(40)
    ] + [(100 + i, f"commit sha {hashlib.sha1(str(i).encode()).hexdigest()} was pushed", "docs/log") for i in range(40)]
    rows.append((900, f"later token = \"{'ab12' * 10}\"", None))
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "secrets")
    found = by_key(secret_scan.scan(docs, secret_scan.by_format))
    assert all(found[i]["kept"] for i in range(40)) and not any(found[100 + i]["kept"] for i in range(40))
    assert found[900]["kept"] and found[900]["start"] == len('later token = "')
    for docs in (odd_docs, no_docs):
        kept = secret_scan.scan(docs, secret_scan.by_format, path="lang")
        assert all(r["score"] == 1.0 for r in kept.collect())


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no address"), (3, "http://WWW.Example.com/en/x?y"), (4, "https://a.example.com/en/#z"), (5, "x://b.net/es/"),
         (6, "http://bad.org/p"), (6, "http://bad.org/p"), (7, "http://good.org"), (None, "http://notcom/")],
        "page_id bigint, url string",
    )
    outcomes = spark.createDataFrame([(6, 1)] * 60 + [(7, 0)] * 60 + [(7, None)], "page_id bigint, bad int")
    rows = url_filter.judge_urls(pages, outcomes, max_bad=0.5).collect()
    found = {r["page_id"]: r for r in rows}
    assert len(rows) == 9 and (found[1]["host"], found[1]["path"], found[1]["verdict"]) == ("", "", "allow")
    assert [found[k]["rule"] for k in (3, 4, 5, None)] == ["www.example.com/en/", "example.com/en/", "net/es/", None]
    assert [found[k]["verdict"] for k in (3, 4, 5, 6, 7)] == ["allow", "block", "block", "block", "allow"]
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages.filter("page_id > 5"), outcomes.limit(0)).collect()} == {"allow"}
