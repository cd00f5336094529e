"""Registered queries without SQL against brute force on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wherewords.llm import language_model, queries, token_files, toxicity
from wherewords.llm.encode import read_tokenizer
from wherewords.llm.tables import table
from wherewords.session import stage, staged_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def shingles(text, size=3):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(sets, percent=90):
    """Smallest key of each key's component, all pairs compared."""
    name = {k: k for k in sets}

    def top(k):
        while name[k] != k:
            k = name[k]
        return k

    holders = defaultdict(list)
    for k, own in sorted(sets.items()):
        shared = Counter(other for s in own for other in holders[s])
        for other, same in shared.items():
            if 100 * same >= percent * (len(own) + len(sets[other]) - same):
                low, high = sorted((top(k), top(other)))
                name[high] = low
        for s in own:
            holders[s].append(k)
    return {k: top(k) for k in sets}


def test_jaccard_join(spark, folder, texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    expected = components(sets)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, folder, "op4_jaccard_join")}
    assert found == {k: (len(sets[k]), expected[k]) for k in sets}


def test_language_model(spark, folder, texts):
    tokens = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts = Counter(w for k, own in tokens.items() if not held[k] for w in own)
    total, distinct = sum(counts.values()), len(counts)
    rows = run(spark, folder, "op7_language_model")
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[w] > 0 for w in own))
        assert (r["held_out"], r["train_tokens"]) == (held[r["doc_id"]], total)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_sums_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(language_model.BUCKETS, language_model.CLASSES))
    logs = language_model.log_softmax(weights, rng.integers(0, 1 << 15, 50))
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    # In a group: known words have their smoothed share, and one unknown word the rest.
    hashes, groups, _ = language_model.tokens_of([" ".join(f"w{i % 70} v{i % 9}" for i in range(500))])
    words, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    for g in range(language_model.GROUPS):
        own = counts[groups[first] == g]
        parts = language_model.SMOOTH + (own + language_model.SMOOTH).sum()
        assert ((own + language_model.SMOOTH) / parts).sum() + language_model.SMOOTH / parts == pytest.approx(1)


def test_token_files(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 0]
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = run(spark, folder, "op9_token_files")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected


@pytest.mark.parametrize("encoding,name", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_token_file_format(spark, folder, encoding, name):
    path = staged_path(spark, "ids")
    tokenizer = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write_token_files(table(spark, folder, "documents"), path, tokenizer, 0, encoding=encoding)
    file = next(f for f in spark.read.parquet(path).inputFiles())
    ids = pq.ParquetFile(file.removeprefix("file:")).metadata.row_group(0).column(4)
    assert ids.path_in_schema.startswith("tokens") and name in ids.encodings
    assert ids.has_offset_index and ids.has_column_index
    plan = token_files.token_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.replace("n_tokens", "")


def test_packing(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = defaultdict(list)
    for r in run(spark, folder, "op10_packing"):
        own[r["doc_id"]].append(r)
    for k, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(own[k], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_toxicity_held_out(spark):
    """On the largest of the plain tables: held-out documents come out right."""
    folder = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    rows = [r for r in run(spark, folder, "op3_toxicity") if r["held_out"] and r["doc_id"] in marks]
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in rows) / len(rows)
    toxic = [r for r in rows if marks[r["doc_id"]]]
    ordinary = [r for r in rows if not marks[r["doc_id"]]]
    assert right > 0.95
    assert sum(r["predicted"] for r in toxic) > 0.7 * len(toxic)
    assert sum(r["predicted"] for r in ordinary) < 0.02 * len(ordinary)


def test_windows_cover_the_text():
    text = "Ünïcode words " * 50 + "x" * 500
    assert b"".join(toxicity.windows_of(text)) == text.lower().encode()
    assert all(len(w) <= toxicity.WINDOW_BYTES for w in toxicity.windows_of(text))


def test_pipeline_stages(spark, folder):
    """Each stage on its own input: what it decides takes effect, and nothing else does."""
    docs = table(spark, folder, "documents")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, step in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(step(spark, docs, folder), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            rows = docs.collect()
            outputs[name] = {r["doc_id"]: r["text"] for r in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    name = "n-gram Jaccard join"
    top = components({k: shingles(t, corpus_pipeline.COPY_WORDS) for k, t in inputs[name].items()}, corpus_pipeline.COPY_PERCENT)
    assert set(outputs[name]) == {k for k in top if top[k] == k}
    for name in ("toxicity", name, "benchmark decontamination"):
        assert outputs[name].items() <= inputs[name].items()
    # Words that are left are in their old order.
    for k, text in outputs["line dedup"].items():
        old = iter(inputs["line dedup"][k].split())
        assert all(word in old for word in text.split())
    assert {r["doc_id"] for r in docs.collect()} == set(inputs["packing"])
