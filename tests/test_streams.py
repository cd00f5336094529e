"""Streams equal batch, also across a restart."""

from pyspark.sql import functions as F

from wherewords.streaming import capture


def write_files(spark, path, ids, files):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in ids], "id bigint, key string")
    rows.repartition(files).write.mode("append").json(path)


def counts(spark, path):
    return {r["key"]: r["n"] for r in spark.read.json(path).groupBy("key").agg(F.count_distinct("id").alias("n")).collect()}


def test_cap_survives_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        stream = capture.read_tweet_stream(spark, source, "id bigint, key string", max_files=1)
        capture.run_available(capture.write_capped_stream(stream, "key", 30, out, checkpoint))

    write_files(spark, source, range(30), 3)
    run()
    assert counts(spark, out) == {"hot": 20, "cold": 10}
    write_files(spark, source, range(30, 120), 3)
    run()
    assert counts(spark, out) == {"hot": 30, "cold": 30}
    write_files(spark, source, range(120, 150), 1)
    run()
    assert counts(spark, out) == {"hot": 30, "cold": 30}


def test_a_repeated_batch_leaves_no_more(spark, tmp_path, monkeypatch):
    """A failure between the rows and the ledger: the batch is run again in full."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write_files(spark, source, range(90), 1)

    def writer():
        stream = capture.read_tweet_stream(spark, source, "id bigint, key string", max_files=1)
        return capture.write_capped_stream(stream, "key", 25, out, checkpoint, order=["id"])

    capture.run_available(writer())
    first = {tuple(r) for r in spark.read.json(out).select("id", "key").collect()}
    assert {i for i, k in first if k == "cold"} == set(range(0, 75, 3))
    # As if the commit had been lost.
    (tmp_path / "cp" / "commits" / "0").unlink()
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    write_files(spark, source, range(90, 120), 1)
    capture.run_available(writer())
    assert {tuple(r) for r in spark.read.json(out).select("id", "key").collect()} == first


def test_rows_without_a_key_and_one_hot_key(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = spark.range(3000).selectExpr("id", "if(id % 100 = 0, null, if(id % 10 = 1, 'few', 'hot')) AS key")
    rows.repartition(3).write.json(source)
    stream = capture.read_tweet_stream(spark, source, "id bigint, key string", max_files=1)
    capture.run_available(capture.write_capped_stream(stream, "key", 20, out, checkpoint))
    assert counts(spark, out) == {"hot": 20, "few": 20, None: 20}
