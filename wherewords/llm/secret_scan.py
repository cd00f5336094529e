"""Secrets in texts: candidates by pattern, false positives out by a random forest.

A candidate is a long run of key characters with a digit, anything in an issuer's format,
or whatever non-blank value is assigned to a secret's name. The forest sees its length and
alphabet, how often neighbouring characters change their kind, how much of it dictionary
words cover, the path of its document, and the words on either side. It is trained on
labelled findings; everything is DataFrame functions and MLlib.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.llm.tables import crc_bucket, table
from wherewords.session import stage

BEFORE, AFTER = 60, 40
#: A word counts as dictionary from this share of all words on: so there are as many at most.
DICTIONARY_WORDS = 20_000
TREES, DEPTH = 30, 8

# Words that stand beside secrets, and beside what only looks like one.
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|credential|private|auth|bearer)"
HARMLESS_WORDS = r"(?i)(sha-?[0-9]*|md5|hash|commit|checksum|digest|uuid|guid|version|build|example|sample|dummy|card|phone|isbn|\bid\b)"
TEST_PATHS = r"(?i)(test|example|sample|fixture|mock|doc)"
# Formats that issuers document.
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"

#: At least 16 key characters with a digit among them.
KEY = r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
_APART, _ENDS = r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])"
#: Behind a secret's name, which may go on behind a mark, and = or :. A look-behind has an
#: end, so up to 8 blanks; the first two conditions only spare most places the third.
ASSIGNED = (
    r"(?<![^=:\s\"'`])(?<=[=:]\s{0,8}[\"'`]?)"
    rf"(?<=(?i:{SECRET_WORDS.removeprefix('(?i)')})(?:[_-][A-Za-z0-9_-]{{0,24}})?[\"'`]?\s{{0,8}}[=:]\s{{0,8}}[\"'`]?)"
)
#: Non-blank characters up to a quote; marks that end a clause don't belong to it.
VALUE = r"(?![=:])[^\s\"'`]*[^\s\"'`,;.)\]}>]"
#: Of an assigned value, the key if nothing but a delimiter follows, else all of it.
CANDIDATE = "|".join([
    _APART + "(?:" + ISSUED.replace("^", "").replace("$", "") + ")" + _ENDS,
    _APART + KEY + r"(?=[\s\"'`,;.)\]}>&=]|$)",
    ASSIGNED + VALUE,
    _APART + KEY,
])


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(row, key, path, number, start, candidate, before, after): all candidates of all texts.

    ``start`` counts code points. Null and empty texts have none; without a path column, or
    with a null, the path is empty; repeated rows are scanned alike.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), where.alias("path"), F.col(text).alias("text"))
    cut = rows.select(
        "row", "key", "path",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE).alias("between"),
    )
    each = cut.filter(F.size("found") > 0).select("row", "key", "path", "between", F.posexplode("found").alias("number", "candidate"))
    left, right = F.get("between", F.col("number")), F.get("between", F.col("number") + 1)
    near = each.select(
        "row", "key", "path", "number", "candidate", F.char_length(left).alias("gap"),
        F.right(left, F.lit(BEFORE)).alias("before"), F.left(right, F.lit(AFTER)).alias("after"),
    )
    so_far = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum((F.col("gap") + F.char_length("candidate")).cast("bigint")).over(so_far)
    return near.withColumn("start", ends - F.char_length("candidate")).drop("gap")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): the frequent words of all texts, 3 to 12 letters, without digits around."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![0-9a-z])[a-z]{3,12}(?![0-9a-z])"), F.lit(0))
    counts = stage(docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return counts.filter(F.col("n") * DICTIONARY_WORDS >= total).select("word")


def _changes(candidate: Column) -> Column:
    kinds = ["[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"]
    pairs = "|".join(f"{a}(?={b})" for a in kinds for b in kinds if a != b)
    return F.regexp_count(candidate, F.lit(pairs))


FEATURES = {
    "length": lambda: F.log1p(F.char_length("candidate")),
    "changes": lambda: _changes(F.col("candidate")) / F.char_length("candidate"),
    "digits": lambda: F.regexp_count("candidate", F.lit("[0-9]")) / F.char_length("candidate"),
    "upper": lambda: F.regexp_count("candidate", F.lit("[A-Z]")) / F.char_length("candidate"),
    "marks": lambda: F.regexp_count("candidate", F.lit("[^A-Za-z0-9]")) / F.char_length("candidate"),
    "hexadecimal": lambda: F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
    "variety": lambda: F.size(F.array_distinct(F.split("candidate", ""))) / F.least(F.char_length("candidate"), F.lit(64)),
    "covered": lambda: F.col("covered") / F.char_length("candidate"),
    "path_depth": lambda: F.regexp_count("path", F.lit("/")).cast("double"),
    "path_test": lambda: F.col("path").rlike(TEST_PATHS).cast("double"),
    "assigned": lambda: F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
    "quoted": lambda: (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
    "secret_word": lambda: F.regexp_count("before", F.lit(SECRET_WORDS)).cast("double"),
    "harmless_word": lambda: F.regexp_count(F.concat("before", F.lit(" "), "after"), F.lit(HARMLESS_WORDS)).cast("double"),
    "in_address": lambda: F.col("before").rlike(r"(://|www\.)[^ ]*$").cast("double"),
}


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with a vector of :data:`FEATURES`. ``words`` has :data:`DICTIONARY_WORDS` at most."""
    runs = found.select("row", "number", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(F.broadcast(words), "word").groupBy("row", "number").agg(F.sum(F.char_length("word")).alias("covered"))
    ready = found.join(covered, ["row", "number"], "left").fillna(0, ["covered"])
    ready = ready.select("*", *(make().cast("double").alias(f"f_{name}") for name, make in FEATURES.items()))
    assembler = VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="features", handleInvalid="keep")
    return assembler.transform(ready).drop(*(f"f_{name}" for name in FEATURES))


def scan(
    docs: DataFrame, labelled, key: str = "doc_id", text: str = "text", path: str | None = "source", limit: float = 0.5
) -> DataFrame:
    """One row per finding: (key, number, start, length, candidate, score, kept).

    ``labelled`` takes the findings and returns those with a label, with a column ``label``
    of 0 or 1. Findings that score below ``limit`` are not kept. With labels of one class
    alone, or none, there is nothing to learn and every finding is kept with score 1.0.
    An empty table has no findings.
    """
    found = stage(findings(docs, key, text, path), "findings")
    ready = stage(with_features(found, stage(dictionary(docs, text), "dictionary")), "features")
    known = labelled(ready).filter(F.col("label").isin(0, 1)).select("features", F.col("label").cast("double").alias("label"))
    classes = known.agg(F.count_distinct("label").alias("n")).first()["n"]
    if classes < 2:
        scored = ready.withColumn("score", F.lit(1.0))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="p", rawPredictionCol="raw", predictionCol="guess")
        scored = forest.fit(known).transform(ready).withColumn("score", F.get(vector_to_array("p"), F.lit(1)))
    return scored.select(
        F.col("key").alias(key), "number", "start", F.char_length("candidate").alias("length"), "candidate", "score",
        (F.col("score") >= limit).alias("kept"),
    )


def by_format(ready: DataFrame) -> DataFrame:
    """Labels where the text itself tells: an issuer's format, or a key or a value of letters
    and digits assigned to a secret's name, is a secret; digits alone, a harmless word just
    before, or dictionary words and nothing else as the value of a secret's name, is none.
    Others, and a fifth of the documents held out, have no label."""
    candidate, assigned = F.col("candidate"), F.col("before").rlike(ASSIGNED + "$")
    secret = candidate.rlike(ISSUED) | (assigned & candidate.rlike(f"^{KEY}$|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"))
    words = assigned & (F.col("covered") >= F.char_length("candidate"))
    harmless = candidate.rlike("^[0-9]+$") & ~assigned | words
    harmless = harmless | F.col("before").rlike(HARMLESS_WORDS + r"[\"']?\s*[=: ]\s*[\"']?$")
    label = F.when(secret, 1).when(harmless, 0)
    return ready.withColumn("label", label).filter(F.col("label").isNotNull() & (crc_bucket(F.col("key"), 5) != 0))


def op1_secret_scan(spark, sf_dir):
    """All findings of all documents; the secret itself only as a digest."""
    found = scan(table(spark, sf_dir, "documents"), by_format)
    return found.withColumn("candidate", F.sha2("candidate", 256)).withColumnRenamed("candidate", "secret_sha256")
