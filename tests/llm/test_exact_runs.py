"""Passages of over 50 words inside lines, against brute force."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from wherewords.llm import exact_runs
from wherewords.llm.tables import table
from wherewords.session import stage
from tests.llm.test_queries import LOWER, WORD


def brute_force(texts):
    """Texts without the words of runs that an earlier document holds, too."""
    words = {k: list(WORD.finditer(t)) for k, t in texts.items()}
    holders, runs = defaultdict(set), {}
    for k, own in words.items():
        low = [w.group().translate(LOWER) for w in own]
        runs[k] = [tuple(low[i : i + 51]) for i in range(len(low) - 50)]
        for run in runs[k]:
            holders[run].add(k)
    left = {}
    for k, own in words.items():
        lost = {i + j for i, run in enumerate(runs[k]) if min(holders[run]) != k for j in range(51)}
        text, begin = "", 0
        for i, w in enumerate(own):
            if i in lost:
                text += texts[k][begin : w.start()] if i - 1 not in lost else ""
                begin = w.end()
        text += texts[k][begin:]
        if not lost or WORD.search(text):
            left[k] = text
    return left


def result(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def planted(spark):
    """Passages of 51, 50 and 148 words in the middle of lines, and one across lines."""
    rng = np.random.default_rng(3)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    long, short, most = own(51), own(50), own(148)
    rows = [
        (1, " ".join([*own(900), *long, *own(80)])), (2, " ".join([*own(30), *long, *own(700)])),
        (3, " ".join([*own(60), *short, *own(60)])), (4, " ".join([*own(90), *short, *own(10)])),
        (5, " ".join([*own(400), *most])), (6, " ".join(own(70)) + "\n" + " ".join(most).replace(" ", "\n").upper() + "\nü" + own(1)[0]),
        (7, " ".join(most[20:120])), (8, " ".join([*most[90:], *own(60), *long])), (9, None), (None, " ".join(long)), (10, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'x' AS source", "cast(char_length(text) AS bigint) AS n_chars"
    )
    return stage(docs, "planted")


def test_passages_inside_lines(spark):
    docs = planted(spark)
    expected = brute_force({r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id is not null").collect()})
    found = result(exact_runs.without_repeated_runs(docs))
    assert 7 not in found and None not in found and len(found[2].split()) == 730
    assert {k: t or "" for k, t in found.items()} == expected and found[9] is None


def test_pipeline_has_no_repeated_passage(spark):
    """The stages before the packing, over single lines with a passage in common."""
    docs, steps = planted(spark).filter("doc_id in (1, 2)"), dict(corpus_pipeline.STAGES)
    for name in [n for n in steps if n not in ("toxicity", "benchmark decontamination", "packing")]:
        docs = stage(steps[name](spark, docs, None), "test-stage")
    rows = docs.collect()
    first, second = ({tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in (r["text"].split() for r in rows))
    assert not first & second and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_documents_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    expected = brute_force(texts)
    assert expected != texts
    assert {k: t or "" for k, t in result(exact_runs.without_repeated_runs(docs)).items()} == expected


def test_empty_and_odd_tables(odd_docs, no_docs):
    assert exact_runs.without_repeated_runs(no_docs).count() == 0
    left = exact_runs.without_repeated_runs(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    # Document 11 is the same run of 3,000 words as 10.
    assert ids == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 12, 13]


def test_smallest_of_each_width():
    values = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 3, 26, 32):
        assert exact_runs.smallest(values, width).tolist() == [min(values[i : i + width]) for i in range(301 - width)]
