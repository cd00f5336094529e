"""Recurring lines by a log-template tree of fixed depth.

A line's path in the tree is its token count, its first tokens, and which of its fields
is variable: tokens with a digit always are, and besides, each of :data:`FIELDS` equal
parts behind the leading tokens may be. A line thus has one template without and one per
part with a variable part; lines that differ inside one part meet in a template. Where a
template occurs in several documents, the document with the smallest key keeps its lines
and the others lose theirs. Templates are hashes, so no line is gathered anywhere: they
are counted with partial sums, and joined back as (template, row, line) numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import changed_rows, free_name, steady_places, table
from wherewords.session import stage

LEADING, FIELDS = 3, 3
#: Lines of fewer fixed tokens are left alone; of fewer tokens, no part is variable.
LEAST_FIXED, LEAST_VARIED = 3, 8
#: Documents in which a template recurs, at least; a line of so many tokens that recurs
#: word by word can't do so by chance, and two are enough.
MIN_DOCS, LONG_TOKENS, MIN_DOCS_LONG = 3, 50, 2

DIGITS = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
TOKEN, FIELD = r"[^\x20\x09-\x0D]+", "<*>"


def _templates(tokens: Column) -> Column:
    """Hashes of a line's templates; the lowest bit marks a long line without variable part."""
    n = F.size(tokens)
    behind = n - LEADING

    def part(k: int) -> Column:
        begin = LEADING + F.floor(behind * k / FIELDS).cast("int")
        end = LEADING + F.floor(behind * (k + 1) / FIELDS).cast("int")
        return F.xxhash64(
            n, F.lit(k + 1), F.concat_ws(" ", F.slice(tokens, 1, begin)), F.concat_ws(" ", F.slice(tokens, end + 1, n))
        ).bitwiseAND(F.lit(-2))

    whole = F.xxhash64(n, F.lit(0), F.concat_ws(" ", tokens)).bitwiseAND(F.lit(-2))
    whole = whole.bitwiseOR((n >= LONG_TOKENS).cast("bigint"))
    fixed = F.size(F.filter(tokens, lambda t: t != FIELD))
    return F.when(fixed < LEAST_FIXED, F.array().cast("array<bigint>")).when(
        n < LEAST_VARIED, F.array(whole)
    ).otherwise(F.array(whole, *(part(k) for k in range(FIELDS))))


def line_templates(text: Column) -> Column:
    """Array with the templates of each line of the text; null for a null."""
    lines = F.split(F.regexp_replace(text, DIGITS, FIELD), "\n")
    tokens = F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
    return F.transform(tokens, _templates)


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, dropped): numbers, from 0, of the lines that a row loses; rows with any.

    ``row`` is a row's place in ``docs``, which must be a stored table.
    """
    steady_places(docs.sparkSession)
    # Staged: read twice, for one pass over the texts.
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), line_templates(F.col(text)).alias("lines")
        ),
        "line-templates",
    )
    own = rows.select("row", "key", F.explode(F.array_distinct(F.flatten("lines"))).alias("template"))
    least = F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, MIN_DOCS_LONG).otherwise(MIN_DOCS)
    recurring = stage(
        own.groupBy("template")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row")).alias("first"))
        .filter(F.col("n") >= least)
        .select("template", F.col("first.row").alias("first_row")),
        "templates",
    )
    found = rows.select("row", F.posexplode("lines").alias("line", "templates")).select(
        "row", "line", F.explode("templates").alias("template")
    )
    return (
        found.join(recurring, "template")
        .filter(F.col("row") != F.col("first_row"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    )


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_lines, n_dropped, dropped).

    Null texts have no lines, an empty text has one; repeated rows and copies lose what
    the first row keeps; among equal keys the first row read is first, null keys are after
    all; other columns are left out; an empty table gives no rows.
    """
    steady_places(docs.sparkSession)
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias(key),
        F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
    )
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return lines.join(recurring_lines(docs, key, text), "row", "left").select(
        key, "n_lines", F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped")
    )


def without_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its columns and the recurring lines taken out of the text.

    Rows of which no line is left are dropped; untouched rows stay as they are.
    """
    dropped = free_name(docs, "dropped")
    lost = stage(recurring_lines(docs, key, text).withColumnRenamed("dropped", dropped), "lost-lines")
    left = F.filter(F.split(F.col(text), "\n"), lambda line, at: ~F.array_contains(dropped, at))

    def change(rows: DataFrame) -> DataFrame:
        return rows.withColumn(text, F.array_join(left, "\n")).filter(F.col(text).rlike(r"[^\x20\x09-\x0D]"))

    return changed_rows(docs, lost, change)


def op8_line_dedup(spark, sf_dir):
    report = line_report(table(spark, sf_dir, "documents"))
    return report.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


_PARTS = ", ".join(
    f"concat(n, '|{k + 1}|', array_to_string(list_slice(t, 1, {LEADING} + (n - {LEADING}) * {k} // {FIELDS}), ' '), '|', "
    f"array_to_string(list_slice(t, {LEADING} + (n - {LEADING}) * {k + 1} // {FIELDS} + 1, n), ' '))"
    for k in range(FIELDS)
)
SQL = f"""
WITH parts AS (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '{DIGITS}', '{FIELD}', 'g'), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, line_no, t, len(t) AS n FROM (SELECT *, regexp_extract_all(line, '{TOKEN}') AS t FROM parts)),
keyed AS (SELECT doc_id, line_no, n >= {LONG_TOKENS} AS long, unnest(CASE
      WHEN len(list_filter(t, lambda x: x <> '{FIELD}')) < {LEAST_FIXED} THEN []
      WHEN n < {LEAST_VARIED} THEN [concat(n, '|0|', array_to_string(t, ' '))]
      ELSE [concat(n, '|0|', array_to_string(t, ' ')), {_PARTS}] END) AS template FROM tokens),
recurring AS (SELECT template, min(doc_id) AS first FROM keyed GROUP BY template
  HAVING count(DISTINCT doc_id) >= CASE WHEN any_value(long) AND contains(template, '|0|')
    AND regexp_matches(template, '^[0-9]+[|]0[|]') THEN {MIN_DOCS_LONG} ELSE {MIN_DOCS} END),
lost AS (SELECT doc_id, list_sort(list(DISTINCT CAST(line_no AS INTEGER))) AS dropped
  FROM keyed JOIN recurring USING (template) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(dropped), 0) AS n_dropped,
  coalesce(array_to_string(dropped, ','), '') AS dropped FROM documents LEFT JOIN lost USING (doc_id)"""
