"""The language model's two softmaxes on small texts."""

import numpy as np
import pytest

from wherewords.llm import language_model
from wherewords.session import stage


@pytest.fixture(scope="module")
def learnt(spark):
    """(lexicon, counts by word) of 2,000 words, the first ones often."""
    texts = [(" ".join(f"w{(i * i + 7 * j) % (1 + 40 * j)}" for i in range(200)),) for j in range(50)]
    lexicon, counts = language_model.learn_lexicon(stage(spark.createDataFrame(texts, "text string"), "texts"))
    return lexicon, {r["word"]: r for r in counts.collect()}


def test_tokens_sum_to_one_in_every_context(learnt):
    """All words, the end and unknown words of all places, under any weights."""
    lexicon, counts = learnt
    classes, width = lexicon.sums.shape
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=(1 << 12, n)).astype(np.float32) for n in (classes, width)]
    hashes = np.array(list(counts), np.int64).view(np.uint64)
    letters = np.array([r["letters"] for r in counts.values()])
    often, ranks = lexicon.held(hashes)
    assert (often == [r["c"] for r in counts.values()]).all()
    own, place = lexicon.classes(hashes, letters, ranks)
    grouped = (ranks < 0) & (own > 0)
    assert grouped.any() and (ranks >= 0).any()
    share = np.where(grouped, (often + language_model.SMOOTH) / lexicon.sums[own, place], 1.0)
    rare = np.repeat(np.arange(1, 1 + language_model.GROUPS), width)
    places = np.tile(np.arange(width), language_model.GROUPS)
    for context in rng.integers(0, 1 << 62, 5):
        known = 10 ** language_model.log_model(lexicon, weights, np.full(len(own), context), own, place)
        unknown = 10 ** language_model.log_model(lexicon, weights, np.full(len(rare), context), rare, places)
        total = (known * share).sum() + (unknown * language_model.SMOOTH / lexicon.sums[rare, places]).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_start_is_the_share_of_the_counts(learnt):
    """Without weights a word with a place of its own has its smoothed share of all tokens."""
    lexicon, counts = learnt
    weights = [np.zeros((1 << 12, n), np.float32) for n in lexicon.sums.shape]
    single = lexicon.ranks >= 0
    hashes, often = lexicon.words[single], lexicon.counts[single]
    own, place = lexicon.classes(hashes, np.zeros(len(hashes), np.int64), lexicon.ranks[single])
    found = 10 ** language_model.log_model(lexicon, weights, np.zeros(len(own), np.int64), own, place)
    assert np.allclose(found, (often + language_model.SMOOTH) / lexicon.sums.sum(), rtol=1e-3)


def test_a_word_follows_the_words_before(spark):
    """Of two words that are equally often, the one that always follows is likelier."""
    words = " ".join(f"{a} {b}" for i in range(60) for a, b in [("red", "apple"), ("blue", "table")][:: 1 - 2 * (i % 2)])
    rows = [(k, words) for k in range(40)] + [(100, "red apple"), (101, "red table"), (102, "blue table"), (103, "blue apple")]
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    found = {r["doc_id"]: r for r in language_model.score_texts(docs, "doc_id < 100").collect()}
    assert found[100]["base_score"] == pytest.approx(found[101]["base_score"])
    assert found[100]["score"] > found[101]["score"] + 0.2
    assert found[102]["score"] > found[103]["score"] + 0.2


def test_both_softmaxes_see_words(spark):
    """Weights move for features of words in both tables, which grow with the vocabulary."""
    few = stage(spark.createDataFrame([("a b c a b d " * 50,)], "text string"), "few")
    many = stage(spark.createDataFrame([(" ".join(f"w{i}" for i in range(30_000)),)], "text string"), "many")
    shapes = []
    for texts in (few, many):
        lexicon, _ = language_model.learn_lexicon(texts)
        weights = language_model.train(texts, lexicon)
        assert all(np.abs(table).max() > 0 for table in weights) or min(lexicon.sums.shape) == 1
        shapes.append([table.shape for table in weights])
    assert all(a[n] < b[n] for a, b in zip(*shapes) for n in (0, 1))
