"""Text functions as Column expressions; all run inside the JVM.

The patterns spell out the Unicode classes instead of ``\\w`` and ``\\s``, whose
meaning differs between regular-expression dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide the results.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same class in its shortest form for this engine's split.
SPLIT = r"(?U)[\s\x1c-\x1f]+"
# A run of it that is not one blank already.
WIDE = r"(?U)[\s\x1c-\x1f](?:(?<! )[\s\x1c-\x1f]*+|(?<= )[\s\x1c-\x1f]++)"
WORD = r"\p{L}\p{N}_"
# Letters that a case-insensitive [A-Za-z] accepts: the ASCII ones and four others.
LETTER = r"A-Za-z\x{130}\x{131}\x{17f}\x{212a}"
MENTION = rf"(?<![{LETTER}0-9_.-])@([{LETTER}][{LETTER}0-9]+)"
# Words are picked, not the rest blanked out: one pass, and no intermediate text.
# A word (group 1) unless it begins a URL, or a URL or a handle (no group).
# ASCII letters and digits are a class of their own to this engine, quicker than their ranges.
CLEAN_WORD = (
    rf"(\p{{Alnum}}++)(?![{WORD}]*+://[^{SPACE}])"
    rf"|(?=\p{{Alnum}})[{WORD}]++://[^{SPACE}]+|@\p{{Alnum}}*"
)
HANDLE = r"(^|[^A-Za-z0-9_!@#$%&*])@[A-Za-z0-9_]+"
TWEET_TOKEN = (
    rf"https?://[^{SPACE}]+|#[{WORD}]+|[{WORD}]+(?:['-][{WORD}]+)*|[^{SPACE}]"
)
VECTOR_TOKEN = rf"[{WORD}]{{2,}}"
# A tag: ``#`` that no other character than white space comes before, up to white space.
HASHTAG = rf"#(?<![^{SPACE}]#)[^{SPACE}]*+"
PLAIN = r"\A[0-9A-Za-z ]*+\z"
WORD_TOKEN = rf"[{WORD}]+|[^{SPACE}{WORD}]"


def single_blanks(text: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(text, WIDE, " ")


def tokens(text: Column) -> Column:
    """Whitespace tokens, none of them empty."""
    return F.filter(F.split(text, SPLIT), lambda t: t != "")


def lower_tokens(words: Column) -> Column:
    return F.transform(words, F.lower)


def hashtag_set(text: Column) -> Column:
    """Distinct whitespace tokens starting with ``#``, without ``#`` at both ends, sorted."""
    tags = F.regexp_extract_all(text, F.lit(HASHTAG), 0)
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.btrim(t, F.lit("#")))))


def hashtags(text: Column) -> Column:
    """:func:`hashtag_set` joined with ``", "``; a lone ``#`` gives an empty tag."""
    return F.array_join(hashtag_set(text), ", ")


def mention_list(text: Column) -> Column:
    """User names after an ``@`` that does not follow a letter, digit, ``_``, ``.`` or ``-``."""
    return F.regexp_extract_all(text, F.lit(MENTION), 1)


def mentions(text: Column) -> Column:
    return F.array_join(mention_list(text), ", ")


def clean_words(text: Column) -> Column:
    """Runs of ASCII letters and digits that are not part of a handle or a URL."""
    return F.filter(F.regexp_extract_all(text, F.lit(CLEAN_WORD), 1), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """:func:`clean_words` with single spaces: handles, URLs and all but ASCII
    letters and digits are gone."""
    return F.array_join(clean_words(text), " ")


def tweet_tokens(text: Column) -> Column:
    """Lower-case message tokens: handles dropped, runs of 3 or more equal
    characters cut to 3; URLs, hashtags, words (with inner ``'`` or ``-``) and
    single other characters are the tokens."""

    def tokenized(value: Column) -> Column:
        # Of ASCII letters, digits and spaces alone, as clean text is, words are the tokens.
        words = F.filter(F.split(F.lower(_runs_cut(value)), " "), lambda t: t != "")
        handles_gone = F.regexp_replace(value, HANDLE, "$1 ")
        other = F.regexp_extract_all(F.lower(_runs_cut(handles_gone)), F.lit(TWEET_TOKEN), 0)
        return F.when(value.rlike(PLAIN), words).otherwise(other)

    return bind(text, tokenized)


def _runs_cut(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1$1")


def vector_tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(VECTOR_TOKEN), 0)


def word_tokens(text: Column) -> Column:
    """Lower-case words and single punctuation characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), 0)


def bigrams(words: Column) -> Column:
    """Neighbouring pairs, joined by a space."""
    return bind(words, lambda w: _grams(w, 2))


def ngrams(words: Column, n: int = 2) -> Column:
    """All 1- to ``n``-grams, shorter ones first."""
    return bind(words, lambda w: F.concat(w, *[_grams(w, m) for m in range(2, n + 1)]))


def _grams(words: Column, m: int) -> Column:
    if m == 2:
        before = F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(1), F.lit(0)))
        after = F.slice(words, F.lit(2), F.size(words))
        grams = F.zip_with(before, after, lambda a, b: F.concat_ws(" ", a, b))
    else:
        starts = F.sequence(F.lit(1), F.size(words) - F.lit(m - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(m)), " "))
    return F.when(F.size(words) >= m, grams).otherwise(F.array().cast("array<string>"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where ``body`` uses
    it inside a lambda (which would otherwise compute it for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doc_text(*parts: Column, sep: str = " ") -> Column:
    """Texts joined by ``sep``; null parts are left out."""
    return F.concat_ws(sep, *parts)


def null_text(value: Column, nan_compat: bool = False) -> Column:
    """Null as empty text, or as the word ``nan`` to match a string cast of missing values."""
    return F.coalesce(value.cast("string"), F.lit("nan" if nan_compat else ""))


def place_parts(name: Column) -> Column:
    """``"City, Region"`` as an array."""
    return F.split(name, ", ")
