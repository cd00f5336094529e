"""Benchmark passages in documents: prefix-filtered containment of item windows.

A window of an item is contained in a document only if all its shingles are. Shingles
are ordered by how rare they are in the documents, and a window needs a prefix of one:
its rarest. Documents' shingles meet the windows on it; where one stands in a window
tells where the window would begin, which must lie inside the document (positional and
length bound), and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.llm.tables import few, steady_places, table, without_rows
from wherewords.session import stage

WINDOW_WORDS, SHINGLE_WORDS = 13, 3
#: Windows that are broadcast at once; a longer list is taken in blocks of so many.
BLOCK_WINDOWS = 50_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in lower case A-Z; none for a null."""
    whole = F.coalesce(text, F.lit(""))
    # The same for ASCII texts, and quicker.
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, LOWER)
    )
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from a position on; differs between sizes."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(window, item, words): windows of consecutive words; a short item is one window."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("all_words"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("all_words") - WINDOW_WORDS, F.lit(0)))
    return (
        words.filter(F.size("all_words") > 0)
        .select("item", "all_words", F.explode(begins).alias("begin"))
        # The same words in several items: one window with all of them.
        .groupBy(F.slice("all_words", F.col("begin") + 1, F.lit(WINDOW_WORDS)).alias("words"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("window", F.monotonically_increasing_id())
    )


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, size, at, shingle): the shingles of each window and where they stand."""
    size = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    at = windows.select(
        "*", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at")
    )
    hashed = F.lit(None).cast("bigint")
    for n in range(1, SHINGLE_WORDS + 1):
        hashed = F.when(F.col("size") == n, _shingle(F.col("words"), F.col("at"), n)).otherwise(hashed)
    return at.select("window", "size", "at", hashed.alias("shingle"))


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, words, pos, size, shingle) of every position, inside the stage that splits the text.
    A row without words has one line, with nulls."""
    # Outer: from a plain one the optimizer infers a filter on the words, and splits twice.
    at = docs.select("row", words_of(F.col("text")).alias("words")).select("row", "words", F.posexplode_outer("words").alias("pos", "word"))
    hashes = [F.struct(F.lit(n).alias("size"), _shingle(F.col("words"), F.col("pos"), n).alias("shingle")) for n in sizes]
    return at.select("row", "words", "pos", F.explode(F.array(*hashes)).alias("at")).select("row", "words", "pos", "at.*")


def passages(
    docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(row, start, length, items), each occurrence of a window in a document; and (row,
    n_words), the words of each document.

    ``docs`` has (row, text). Windows are few and go to all tasks in blocks of
    :data:`BLOCK_WINDOWS`, so that no text is shuffled. Texts are split once for each block,
    and those with a window's rarest shingle at a place that fits once more.
    """
    windows = stage(item_windows(benchmark, item, text), "windows")
    shingles = stage(_window_shingles(windows), "window-shingles")
    shape = windows.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(F.least(F.size("words"), F.lit(SHINGLE_WORDS)))).alias("sizes")
    ).first()
    sizes = shape["sizes"] or [SHINGLE_WORDS]
    blocks = max(1, -(-shape["n"] // BLOCK_WINDOWS))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = lengths = None
    for number in range(blocks):
        mine = shingles.filter(block == number)
        known = F.broadcast(mine.select("shingle").distinct().withColumn("known", F.lit(True)))
        begins = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("size") == sizes[0])
        met = stage(
            _document_shingles(docs, sizes).join(known, "shingle", "left").filter(F.col("known") | begins)
            .select("row", F.size("words").alias("n_words"), "pos", begins.alias("begins"), F.when(F.col("known"), F.col("shingle")).alias("shingle")),
            "met-shingles",
        )
        lengths = met.filter("begins").select("row", F.col("n_words").cast("bigint")) if lengths is None else lengths
        met = met.filter("shingle is not null")
        prefix = (
            mine.join(met.groupBy("shingle").agg(F.count("*").alias("often")), "shingle", "left")
            .groupBy("window")
            .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "at")).alias("first"))
            # A shingle that no document has: its window is nowhere.
            .filter(F.col("first.often") > 0)
            .select("window", F.col("first.shingle").alias("shingle"), F.col("first.at").alias("at"))
        )
        wanted = stage(
            prefix.join(windows, "window").select(
                "shingle", "at", F.col("words").alias("window_words"), "items", F.size("words").alias("length")
            ),
            "window-prefixes",
        )
        start = F.col("pos") - F.col("at")
        inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
        rows = stage(
            met.join(F.broadcast(wanted.select("shingle", "at", "length")), "shingle").filter(inside).select("row").distinct(),
            "promising-rows",
        )
        here = _document_shingles(docs.join(few(rows), "row", "left_semi"), sizes)
        fits = (
            (here["shingle"] == wanted["shingle"])
            & (start >= 0)
            & (start + F.col("length") <= F.size("words"))
            & (F.slice("words", start + 1, F.col("length")) == F.col("window_words"))
        )
        hits = here.join(F.broadcast(wanted), fits).select("row", start.alias("start"), "length", "items")
        found = hits if found is None else found.unionAll(hits)
    return found, lengths


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """One row per document: (key, n_words, n_hit, n_items, items_sha256, contaminated).

    ``n_hit`` counts the words inside any occurrence of a window. Nulls and empty texts
    have no words and are clean; an item without words has no window; repeated items count
    once, repeated documents are judged alike; null keys stay; other columns are left out.
    An item without an id is looked for, but not named. Contaminated: hit words are a
    twentieth of all words at least. ``docs`` is a stored table:
    it is read more than once, and rows are told apart by their place in it.
    """
    return _judged(docs, benchmark, key, text, item).drop("row")


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """``docs`` with its columns, but for the contaminated rows."""
    judged = _judged(docs, benchmark, key, text, item)
    return without_rows(docs, stage(judged.filter("contaminated").select("row"), "contaminated"))


def _judged(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """:func:`contamination` with the place of each row."""
    steady_places(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    hits, words = passages(rows.select("row", "text"), benchmark, item, text)
    hits = stage(hits, "passages")
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    # Words that no earlier window of the row has covered.
    fresh = F.greatest(end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), "start"), F.lit(0))
    spans = hits.groupBy("row", "start").agg(F.max("length").alias("length"))
    covered = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("found"))
    judged = covered.join(named, "row", "left")
    found = F.coalesce(F.sort_array("found"), F.array().cast("array<string>"))
    lengths = rows.select("row", "key").join(words, "row")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return lengths.join(judged, "row", "left").select(
        "row", F.col("key").alias(key), "n_words", hit.alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op6_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS words FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS words FROM benchmark),
windows AS (SELECT item_id, list_slice(words, s, s + {WINDOW_WORDS - 1}) AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW_WORDS - 1}, 1) + 1)) AS s FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
spots AS (SELECT doc_id, n, list_slice(words, s, s + n - 1) AS win, s
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, lengths WHERE len(words) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM spots JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
