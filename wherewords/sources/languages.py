"""Language dimensions: code recoding, stemmer routing, suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wherewords.session import small_table

# Language codes that count as another language.
LANGUAGE_MAP = [
    ("en-GB", "en"), ("en-gb", "en"), ("sr", "en"), ("fil", "en"),
    ("es-MX", "es"),
    ("zh-CN", "zh"), ("zh-TW", "zh"), ("zh-cn", "zh"), ("zh-tw", "zh"),
    ("uk", "nl"),
    ("pt-PT", "pt"),
]

# Which language's rules stem a language; all others have no stemmer.
STEM_ROUTES = {
    "ca": "es", "eu": "es", "da": "da", "nl": "nl", "en": "en", "fi": "fi", "fr": "fr",
    "de": "de", "hu": "hu", "it": "it", "no": "no", "pt": "pt", "ro": "ro", "ru": "ru",
    "es": "es", "tr": "tr",
}

# The routing with Finnish stemmed as English and its own stemmer under a mistyped code.
COMPAT_STEM_ROUTES = {**STEM_ROUTES, "fi": "en", "fu": "fi"}

# Suffix rules: language, suffix, replacement, shortest stem left. The longest
# matching suffix wins. A light list of our own; pass another one to replace it.
STEM_RULES = [
    ("en", "ational", "ate", 2), ("en", "fulness", "ful", 2), ("en", "ousness", "ous", 2),
    ("en", "ization", "ize", 2), ("en", "ingly", "", 3), ("en", "edly", "", 3),
    ("en", "ies", "i", 2), ("en", "sses", "ss", 1), ("en", "ing", "", 3), ("en", "ed", "", 3),
    ("en", "ly", "", 3), ("en", "s", "", 3),
    ("de", "ungen", "ung", 3), ("de", "heiten", "heit", 3), ("de", "ern", "", 3),
    ("de", "en", "", 3), ("de", "er", "", 3), ("de", "es", "", 3), ("de", "e", "", 3),
    ("es", "amiento", "", 3), ("es", "aciones", "", 3), ("es", "mente", "", 3),
    ("es", "ando", "", 3), ("es", "iendo", "", 3), ("es", "os", "", 3), ("es", "as", "", 3),
    ("es", "es", "", 3),
    ("fr", "issement", "", 3), ("fr", "ement", "", 3), ("fr", "ations", "", 3),
    ("fr", "eux", "", 3), ("fr", "aux", "al", 2), ("fr", "es", "", 3), ("fr", "s", "", 3),
    ("da", "erne", "", 3), ("da", "er", "", 3), ("da", "en", "", 3),
    ("nl", "heden", "heid", 3), ("nl", "en", "", 3), ("nl", "s", "", 3),
    ("fi", "ssa", "", 3), ("fi", "sta", "", 3), ("fi", "n", "", 3),
    ("hu", "ban", "", 3), ("hu", "nak", "", 3), ("hu", "k", "", 3),
    ("it", "mente", "", 3), ("it", "zioni", "zion", 2), ("it", "i", "", 3), ("it", "e", "", 3),
    ("no", "ene", "", 3), ("no", "er", "", 3), ("no", "en", "", 3),
    ("pt", "mente", "", 3), ("pt", "oes", "ao", 2), ("pt", "os", "", 3), ("pt", "as", "", 3),
    ("ro", "ilor", "", 3), ("ro", "ul", "", 3), ("ro", "e", "", 3),
    ("ru", "ov", "", 3), ("ru", "y", "", 3),
    ("tr", "lar", "", 3), ("tr", "ler", "", 3),
]


def language_dimension(spark: SparkSession) -> DataFrame:
    return small_table(spark, LANGUAGE_MAP, "raw string, canonical string")


def stem_rule_dimension(
    spark: SparkSession, rules: list[tuple] = STEM_RULES, routes: dict = STEM_ROUTES
) -> DataFrame:
    """The rules under the code of every language routed to them."""
    rows = [
        (lang, suffix, replacement, min_stem)
        for lang, route in routes.items()
        for rule_lang, suffix, replacement, min_stem in rules
        if rule_lang == route
    ]
    return small_table(
        spark, rows, "lang string, suffix string, replacement string, min_stem int"
    )
