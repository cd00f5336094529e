"""Hosts without outcomes: the posterior of their domain, else of their suffix, else of all."""

import re

import pytest
from pyspark.sql import functions as F

from wherewords.llm import decontaminate, exact_runs, jaccard_join, line_dedup, toxicity, url_filter
from wherewords.session import stage


def pages(spark):
    rows = [(i, f"http://a{i % 5}.bad.org/x") for i in range(400)] + [(1000 + i, f"http://b{i % 5}.good.com/x") for i in range(400)]
    rows += [(2000, "http://new.bad.org/"), (2001, "http://new.good.com/"), (2002, "http://other.org/"), (2003, "http://none.info/"), (2004, None)]
    rows += [(2005, "http://" + "x" * 100_000 + ".bad.org/" + "y" * 100_000)]
    extra = {name: F.lit("k") for name in ("host", "bad", "rate", "rule", "fit", "n", "domain")}
    return stage(spark.createDataFrame(rows, "page_id bigint, url string").withColumns(extra), "pages")


def test_unseen_hosts(spark):
    outcomes = spark.createDataFrame([(i, int(i < 1000 or i % 50 == 0)) for i in [*range(400), *range(1000, 1400)]], "page_id bigint, bad int")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages(spark), outcomes, rules=[]).collect()}
    assert len(found) == 806
    assert found[0]["verdict"] == found[2000]["verdict"] == found[2005]["verdict"] == "block"
    assert found[1001]["verdict"] == found[2001]["verdict"] == "allow"
    rate = {k: found[k]["rate"] for k in (2000, 2001, 2002, 2003, 2004)}
    # Domains differ from their suffix, which the overall share pulls in.
    assert rate[2000] > rate[2002] > rate[2003] > rate[2001] and rate[2003] == rate[2004]


def test_registered_domains(spark):
    hosts = ["", "a", "a.b", "x.a.b", "co.uk", "a.co.uk", "x.a.co.uk", "a.com.", ".", "..", "uk", "a.co.fr", "a..uk", "co.co.uk"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.registered(F.col("host")).alias("r")).collect()
    for r in rows:
        found = re.search(url_filter.REGISTERED, r["host"])
        assert (r["r"]["domain"], r["r"]["suffix"]) == (found.group(0), found.group(2)), r["host"]


def test_without_outcomes_all_are_allowed(spark):
    none = spark.createDataFrame([], "page_id bigint, bad int")
    rows = url_filter.judge_urls(pages(spark), none, rules=[]).collect()
    assert len(rows) == 806 and {r["verdict"] for r in rows} == {"allow"}


@pytest.mark.parametrize("stage_of", [
    lambda docs, bench: toxicity.without_toxic(docs, toxicity.UNKNOWN),
    lambda docs, bench: line_dedup.without_recurring_lines(docs),
    lambda docs, bench: exact_runs.without_repeated_runs(docs),
    lambda docs, bench: jaccard_join.one_per_component(docs, words=5, percent=80),
    lambda docs, bench: decontaminate.without_contaminated(docs, bench),
])
def test_stages_on_empty_tables(spark, no_docs, odd_docs, stage_of):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert stage_of(no_docs, bench).columns == no_docs.columns and stage_of(no_docs, bench).count() == 0
    kept = stage_of(odd_docs, bench)
    assert kept.columns == odd_docs.columns and 0 < kept.count() <= odd_docs.count()
    assert {r["lang"] for r in kept.collect()} <= {r["lang"] for r in odd_docs.collect()}


def test_null_keys_are_last_in_line_dedup(spark):
    line = " ".join(f"word{i}x" for i in range(60)).replace("0", "a").replace("1", "b").replace("2", "c")
    line = "".join(c if not c.isdigit() else "q" for c in line)
    docs = stage(spark.createDataFrame([(None, line), (7, line), (9, line)], "doc_id bigint, text string"), "null-keys")
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(docs).collect()}
    assert dropped == {None: 1, 7: 0, 9: 1}
