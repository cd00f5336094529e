"""The LSH forest against brute force over all pairs."""

import numpy as np
import pytest

from wherewords.llm import lsh_forest, queries
from wherewords.llm.tables import table
from wherewords.session import stage
from tests.llm.test_near_copies import components, shingles


def result(frame, key="doc_id"):
    return {r[key]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def expected(texts, size, percent):
    sets = {k: shingles(t or "", size) for k, t in texts.items()}
    top = components(sets, percent)
    return {k: (len(sets[k]), top[k], top[k] == k) for k in sets}


def test_documents(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    assert result(queries.QUERIES["op13_lsh_forest"](spark, folder)) == expected(texts, 3, 85)


def family(rng, n, size, changes):
    """Texts of one family: each with some words changed, so that similarities lie around the limit."""
    first = [f"w{x}" for x in rng.integers(0, 10**9, size)]
    texts = []
    for _ in range(n):
        own = list(first)
        for at in rng.choice(size, rng.integers(0, changes), replace=False):
            own[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("task_rows", [200_000, 150])
def test_dense_regions_and_cuts(spark, monkeypatch, task_rows):
    """Families far larger than a region, and tasks that cut them anywhere."""
    monkeypatch.setattr(lsh_forest, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(task_rows)
    texts = family(rng, 150, 200, 8) + family(rng, 60, 60, 6) + family(rng, 2, 40, 2)
    shared = " ".join(f"s{x}" for x in rng.integers(0, 10**9, 60))
    texts += [shared + " " + " ".join(f"y{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(80)] + texts[:40]
    order = rng.permutation(len(texts))
    docs = stage(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order.tolist())], "doc_id bigint, text string"), "family")
    assert result(lsh_forest.near_copies(docs)) == expected({i: texts[k] for i, k in enumerate(order.tolist())}, 5, 80)


def test_links_are_found(spark):
    """Pairs a little above the limit, each a family of its own: recall."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(300):
        first = [f"w{x}" for x in rng.integers(0, 10**9, 150)]
        texts += [" ".join(first), " ".join(first[:138] + [f"x{x}" for x in rng.integers(0, 10**9, 12)])]
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "pairs")
    found = result(lsh_forest.near_copies(docs))
    assert expected(dict(enumerate(texts)), 5, 80)[1][1] == 0
    assert sum(found[i][1] == i - 1 for i in range(1, 600, 2)) >= 0.99 * 300


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.8):
        both, own = int(1000 * share), 1000 - int(1000 * share)
        common = rng.integers(0, 1 << 63, both).astype(np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 63, own).astype(np.uint64)]) for _ in range(2)]
        values = lsh_forest.minhash(sets)
        assert abs((values[0] == values[1]).mean() - both / (both + 2 * own)) < 0.13


def test_odd_documents(odd_docs, no_docs):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.near_copies(odd_docs, words=3, percent=85).collect()]
    by_key = {f[0]: f[1:] for f in found if f[0] is not None}
    assert len(found) == odd_docs.count()
    assert by_key[1] == (0, 1, True) and by_key[3] == (0, 3, True) and by_key[5] == (1, 4, False) and by_key[11] == (2998, 10, False)
    assert sorted(f for f in found if f[0] == 6) == [(6, 4, 6, True)] * 2
    # Without a key: one is a copy of 6, the other has no text.
    assert sorted((f for f in found if f[0] is None), key=str) == [(None, 0, None, True), (None, 4, 6, False)]
    assert lsh_forest.near_copies(no_docs).count() == 0


def test_copies_without_a_key(spark):
    docs = stage(spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r")], "doc_id bigint, text string"), "no-keys")
    assert sorted(r["kept"] for r in lsh_forest.near_copies(docs).collect()) == [False, True, True]
