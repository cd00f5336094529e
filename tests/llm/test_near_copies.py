"""Near copies at other shingles and similarities than those of op4, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from wherewords.llm import jaccard_join
from wherewords.llm.tables import table
from wherewords.session import stage
from tests.llm.test_queries import LOWER, WORD


def shingles(text, size):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(sets, percent):
    name = {k: k for k in sets}

    def top(k):
        while name[k] != k:
            k = name[k]
        return k

    keys = sorted(k for k in sets if sets[k])
    for i, b in enumerate(keys):
        for a in keys[:i]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((top(a), top(b)))
                name[high] = low
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("size,percent", [(5, 80), (1, 70), (3, 90)])
def test_other_settings(spark, folder, size, percent):
    docs = table(spark, folder, "documents")
    sets = {r["doc_id"]: shingles(r["text"] or "", size) for r in docs.collect()}
    top = components(sets, percent)
    rows = jaccard_join.near_duplicates(docs, words=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {k: (len(sets[k]), top[k]) for k in sets}


def test_short_texts_are_one_shingle(spark):
    rows = [(1, "a b c d"), (2, "A  b c d"), (3, "a b d c"), (4, "a b c"), (5, "a"), (6, "b"), (7, "")]
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "short")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, words=5, percent=80).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (0, 7)}


def test_pipeline_leaves_no_near_copies(spark):
    """Four of 204 words changed: similar enough by 5 words and 80 %, not by 3 and 90."""
    words = [f"w{x}" for x in np.random.default_rng(8).integers(0, 10**9, 204)]
    four = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(four)), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'x' AS source", "cast(char_length(text) AS bigint) AS n_chars"
    )
    docs = stage(docs, "copies")
    sets = [{k: shingles(t, n) for k, t in rows} for n in (3, 5)]
    assert components(sets[0], 90)[2] == 2 and components(sets[1], 80)[2] == 1
    steps = dict(corpus_pipeline.STAGES)
    for name in [n for n in steps if n not in ("toxicity", "benchmark decontamination", "packing")]:
        docs = stage(steps[name](spark, docs, None), "test-stage")
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]
