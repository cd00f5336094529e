"""Hard negatives against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherewords.llm import hard_negatives
from wherewords.session import stage


def brute_force(rows, anchors, positives=5, negatives=3, low=50, high=95):
    kept = defaultdict(list)
    for key, label, vector in rows:
        if key is not None and label is not None and vector is not None and None not in vector:
            kept[key].append((label, vector))
    rows = [(key, *min(of)) for key, of in kept.items()]
    found = []
    for anchor, label, vector in rows:
        if anchor not in anchors:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(vector, v)), key, other == label) for key, other, v in rows if key != anchor)
        for p, positive, same in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and -low * p <= -100 * s[0] <= -high * p][:negatives]
            found += [(anchor, positive, i + 1, key, -p, -s) for i, (s, key, _) in enumerate(fit)]
    return sorted(found)


def result(frame):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def made(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>")
    return stage(frame.withColumns({name: F.lit(7) for name in ("id", "anchor", "slot", "score", "rank", "limits", "down")}), "vectors")


@pytest.mark.parametrize("scale", [3, 2_000, 10**8])
def test_blocks_ties_and_scales(spark, monkeypatch, scale):
    """Few distinct vectors, so that scores tie; blocks that cut anchors and rows anywhere."""
    monkeypatch.setattr(hard_negatives, "ROWS", 13)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rng = np.random.default_rng(scale)
    rows = [(i, int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])), [int(x) for x in rng.integers(-scale, 2 * scale, 4)]) for i in range(120)]
    found = result(hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 10 == 0))
    expected = brute_force(rows, set(range(0, 120, 10)))
    assert expected and found == expected


def test_other_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [int(x) for x in rng.integers(0, 9, 5)]) for i in range(60)]
    found = result(hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id") < 6, positives=2, negatives=7, low=20, high=100))
    assert found == brute_force(rows, set(range(6)), 2, 7, 20, 100)


def test_odd_rows(spark):
    """Nulls, repeated keys, vectors of other lengths, an anchor without positives, negative scores."""
    rows = [
        (0, 1, [5, 5]), (0, 1, [5, 5]), (0, 2, [9, 9]), (1, 1, [4, 4]), (2, 1, [4, 4, 100]), (3, 2, [3, 3]), (4, 2, [3]), (5, 2, []),
        (6, None, [1, 1]), (7, 1, None), (8, 1, [1, None]), (None, 2, [3, 3]), (10, 5, [1, 1]), (11, 6, [-4, -4]), (12, 6, [1, 1]), (13, 2, [4, 3]),
        (14, 1, [0, 0]), (15, 2, [1, -1]),
    ]
    expected = brute_force(rows, {0, 5, 10, 11, None})
    assert expected
    assert result(hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id").isin(0, 5, 10, 11) | F.col("label").isNull())) == expected
    assert hard_negatives.hard_negatives(made(spark, []), F.col("vec_id") > 0).count() == 0


def test_whole_numbers(spark):
    rows = [([0.0039, -0.0001, 1.0],), ([float("nan")],), ([float("inf")],), ([1.0, None],), (None,), ([],)]
    found = spark.createDataFrame(rows, "v array<float>").select(hard_negatives.whole_numbers(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in found] == [[0, -1, 256], None, None, None, None, []]
