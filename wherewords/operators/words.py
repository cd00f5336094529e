"""Words of messages as long tables: stop words, stems, counts, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.functions import text
from wherewords.sources.languages import STEM_ROUTES, STEM_RULES


#: Rules that one generated method tests.
RULES_AT_ONCE = 24


def explode_tokens(df: DataFrame, keys: list[str], words: Column, out: str = "word") -> DataFrame:
    """One row per token with its position."""
    return df.select(*keys, F.posexplode(words).alias("pos", out))


def remove_stopwords(tokens: DataFrame, stopwords: DataFrame, lang: str = "user_lang") -> DataFrame:
    """Tokens that are no stop word of their row's language, in lower case.

    A language without a list keeps all its tokens. The list is the small side
    of a hash anti join; the tokens stay where they are.
    """
    lowered = tokens.withColumn("word", F.lower("word"))
    return lowered.join(
        stopwords.select(F.col("lang").alias(lang), "word"), [lang, "word"], "left_anti"
    )


def stem(
    token: str, lang: str, rules: list[tuple] = STEM_RULES, routes: dict = STEM_ROUTES
) -> Column:
    """The token (a column name) with the longest matching suffix of its language
    (a column name) replaced.

    CASE expressions pick the rule, so stemming needs neither a join nor a Python worker.
    A method of over 8000 bytes is never compiled by HotSpot, so there is one CASE for every
    :data:`RULES_AT_ONCE` rules or so. Each yields only a rule's number, null for the other
    languages, and is used twice, which makes it a method of its own.
    """
    if any(min_stem + len(replacement) < 2 for _, _, replacement, min_stem in rules):
        raise ValueError("a stem rule must leave two characters or more")
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    groups: list[list[str]] = []
    room = 0
    for route in sorted({r[0] for r in rules}):
        langs = ", ".join(_quote(code) for code, target in routes.items() if target == route)
        cases = [
            f"WHEN endswith({token}, {_quote(suffix)}) AND length({token}) >= {len(suffix) + min_stem} THEN {i}"
            for i, (rule_route, suffix, _, min_stem) in enumerate(ordered)
            if rule_route == route
        ]
        if langs:
            if len(cases) > room:
                groups.append([])
                room = RULES_AT_ONCE
            room -= len(cases)
            groups[-1].append(f"WHEN {lang} IN ({langs}) THEN CASE {' '.join(cases)} END")
    if not groups:
        return F.col(token)
    cuts = f"array({', '.join(str(len(r[1])) for r in ordered)})"
    endings = f"array({', '.join(_quote(r[2]) for r in ordered)})"
    numbers = [f"CASE {' '.join(branches)} END" for branches in groups]
    cut = ", ".join(f"get({cuts}, {number})" for number in numbers)
    ending = ", ".join(f"get({endings}, {number})" for number in numbers)
    return F.expr(f"left({token}, length({token}) - greatest({cut}, 0)) || concat_ws('', {ending})")


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_stemmer(lang: Column, routes: dict = STEM_ROUTES) -> Column:
    return lang.isin(list(routes))


def stem_vocabulary(tokens: DataFrame, rules: DataFrame, lang: str = "user_lang") -> DataFrame:
    """(lang, word, stem) for the distinct words, with the rules as a table.

    For a rule table of any size: every suffix length of a word is looked up in
    the rules and the longest hit wins.
    """
    longest = F.least(F.length("word"), F.lit(1) + rules.agg(F.max(F.length("suffix"))).scalar())
    vocabulary = tokens.select(F.col(lang).alias("lang"), "word").distinct()
    suffixes = vocabulary.select(
        "lang", "word", F.explode(F.sequence(F.lit(0), longest)).alias("cut")
    ).withColumn("suffix", F.expr("right(word, cut)"))
    hits = suffixes.join(rules, ["lang", "suffix"], "left").withColumn(
        "stem",
        F.when(
            F.length("word") - F.col("cut") >= F.col("min_stem"),
            F.concat(
                F.substring("word", F.lit(1), F.length("word") - F.col("cut")),
                F.col("replacement"),
            ),
        ),
    )
    best = F.max_by("stem", F.when(F.col("stem").isNotNull(), F.col("cut")))
    return hits.groupBy("lang", "word").agg(F.coalesce(best, F.col("word")).alias("stem"))


def description_tokens(
    df: DataFrame, stopwords: DataFrame, key: str = "tweet_id", lang: str = "user_lang"
) -> DataFrame:
    """Clean, filtered and stemmed words of the user description, by position."""
    words = text.clean_words(F.col("user_description"))
    kept = remove_stopwords(explode_tokens(df, [key, lang], words), stopwords, lang)
    return kept.select(key, lang, "pos", stem("word", lang).alias("word"))


def _message_words(df: DataFrame, keys: list[str], lang: str, drop_unstemmed: bool) -> DataFrame:
    """(keys, _lang, _word): lower-case words and hashtags, two characters at least."""
    if drop_unstemmed:
        df = df.filter(has_stemmer(F.col(lang)))
    words = text.clean_words(F.col("text"))
    tags = text.clean_words(text.hashtags(F.col("text")))
    # A clean word holds no "#", so the sign marks the tags among the words.
    marked = F.concat(words, F.transform(tags, lambda t: F.concat(F.lit("#"), t)))
    long = df.select(
        *keys, F.col(lang).alias("_lang"), F.explode(marked).alias("_word")
    ).select(*keys, "_lang", F.lower("_word").alias("_word"))
    # Tested before stemming, which leaves two characters: the stem stays out of
    # the filter and is computed once.
    return long.filter(F.length(F.ltrim("_word", F.lit("#"))) >= 2)


def _stemmed(words: DataFrame, stopwords: DataFrame, *keep: str) -> DataFrame:
    """(keep, term) without stop words."""
    stops = stopwords.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"))
    kept = words.join(stops, ["_lang", "_word"], "left_anti")
    # Tags have no language here, so they are not stemmed.
    words_only = F.when(~F.col("_word").startswith("#"), F.col("_lang"))
    kept = kept.withColumn("_lang", words_only)
    # No word is null. Said here, or a join on the term would test it below, by a second stemming.
    term = F.coalesce(F.ltrim(stem("_word", "_lang"), F.lit("#")), F.lit(""))
    return kept.select(*keep, term.alias("term"))


def message_terms(
    df: DataFrame,
    stopwords: DataFrame,
    keys: list[str],
    lang: str = "user_lang",
    drop_unstemmed: bool = False,
) -> DataFrame:
    """Terms of a message, one row per occurrence: the stemmed words of the clean
    text without stop words, and the clean hashtags; two characters at least.

    ``drop_unstemmed`` leaves out the rows of languages that have no stemmer.
    All steps up to the counts are one stage without a shuffle.
    """
    return _stemmed(_message_words(df, keys, lang, drop_unstemmed), stopwords, *keys)


def message_term_counts(
    df: DataFrame, stopwords: DataFrame, key: str, lang: str = "user_lang", drop_unstemmed: bool = False
) -> DataFrame:
    """(key, term, tf): :func:`message_terms` counted. Raw words are counted first, so that each
    is looked up among the stop words and stemmed once per document and language."""
    counts = _message_words(df, [key], lang, drop_unstemmed).groupBy(key, "_lang", "_word").agg(F.count("*").alias("_n"))
    return _stemmed(counts, stopwords, key, "_n").groupBy(key, "term").agg(F.sum("_n").alias("tf"))


def term_counts(terms: DataFrame, key: str, term: str = "term") -> DataFrame:
    """Occurrences per (document, term). Combined before the shuffle, and the
    term spreads the rows of a hot document over all tasks."""
    return terms.groupBy(key, term).agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame, term: str = "term") -> DataFrame:
    """Number of documents with each term."""
    return tf.groupBy(term).agg(F.count("*").alias("df"))


def vocabulary(tf: DataFrame, term: str = "term") -> DataFrame:
    """Distinct terms with a fixed id: the term's 64-bit hash, so that ids need
    no global order."""
    return tf.select(term).distinct().withColumn("term_id", F.xxhash64(term))


def bag_of_words(tf: DataFrame, vocab: DataFrame, term: str = "term") -> DataFrame:
    """Counts under the ids of a vocabulary; unknown terms are left out."""
    return tf.join(vocab, term)
