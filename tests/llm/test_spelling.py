"""Spelling variants against brute force over all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wherewords.llm import queries, spelling
from wherewords.llm.tables import table
from wherewords.session import stage
from tests.llm.test_queries import LOWER


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts):
    """word -> (form, root, n, n_near, form_n); words that may be near share a word without a letter."""
    buckets, close = defaultdict(set), defaultdict(set)
    for w in counts:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            buckets[cut].add(w)
    for words in buckets.values():
        for a in words:
            close[a] |= {b for b in words if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(close[w], key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(close[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def result(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def counted(texts):
    counts = Counter()
    for k, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def test_documents(spark, folder):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    expected = grouped(counted(texts))
    assert any(e[0] for e in expected.values())
    assert result(queries.QUERIES["op11_spelling_variants"](spark, folder)) == expected


@pytest.mark.parametrize("most", [1, 3, 40, 4000])
def test_partitions_of_any_size(spark, most):
    """Words that begin alike, repeat letters and are prefixes of each other."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(400)} | {"", "a" * 40, "a" * 41, "b" + "a" * 40}
    words |= {"same beginning" + "".join(rng.choice(list("xy"), 4)) for _ in range(20)}
    docs = stage(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), "words")
    found = [(r["a"], r["b"]) for r in spelling.near_pairs(docs, most).collect()]
    ordered = sorted(words)
    assert sorted(found) == [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if near(a, b)]


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(f"{a}{b}ing" for a in "abc" for b in "xyz"))
    reached, todo = {0}, [0]
    while todo:
        new = set(acceptor.arcs[todo.pop()].values()) - reached
        reached |= new
        todo += new
    assert len(reached) == 6 and len(acceptor.pairs()) == 2 * 9


def test_chains_ties_and_nulls(spark):
    counts = {"abcdefg": 20_000, "abcdefx": 1_500, "abcdeyx": 120, "abczeyx": 12, "mnopqrs": 30, "mnopqrt": 30, "mnopqru": 3, "lonely!": 5}
    rows = [(w, n, 1) for w, n in counts.items()] + [(None, 3, 1), ("nothing", None, 1)]
    found = result(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n int, root int")))
    assert found == grouped(counts)
    assert found["abczeyx"][:2] == ("abcdeyx", "abcdefg") and found["mnopqru"][0] == "mnopqrs"
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(5, "Variant variant vàriant " * 3), (None, "VARIANT varÀant " + "y" * 20_000)] * 2
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "odd-words")
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    found = spelling.vocabulary(docs, loss=31)
    assert {r["word"]: r["n"] for r in found.collect()} == counted(rows)
    assert result(spelling.spelling_groups(found)) == grouped(counted(rows))
    assert spelling.vocabulary(no_docs).count() == 0
