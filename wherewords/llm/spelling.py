"""Spelling variants: pairs of words that are one edit apart, by composing automata.

The vocabulary is an acceptor ``A``, and one edit a transducer ``E`` of two states: before the
edit it copies, one arc replaces, inserts or deletes a letter, and then it copies again. The
accepted pairs of ``A E A`` are what is asked for. The composition is taken apart at the top:

* as long as no edit is made, both sides are in the same state, which a prefix names. Where
  more than :data:`BLOCK_WORDS` words begin with a prefix, the arcs of ``E`` that edit
  right there lead to two states of ``A`` of which only equal rests are accepted: words meet in
  a join on (place of the edit, word without that letter), at most one for each letter;
* a prefix with fewer words is the initial state of a partition. Its task builds the minimal
  acceptor of what comes after the prefix, composes it, and enumerates the accepted pairs.

So a task never holds more than :data:`BLOCK_WORDS` words, however many begin alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import small_batches, table, texts_of
from wherewords.session import small_table, stage

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A near word is a word's form from so many times its count on.
FORM_TIMES = 10
#: Words of a partition, and letters by which prefixes grow in a round.
BLOCK_WORDS, GROWTH = 4000, 4
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: op11: a run whose hash this divides loses a letter.
LOSS = 31

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
# Runs that are shorter can't become words.
_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def words_in(key, text: str, loss: int | None) -> Counter:
    """How often each word is in a text. With ``loss``, a run loses the letter its hash names."""
    counts: Counter = Counter()
    for run, n in Counter(_RUN.findall(text)).items():
        counts[run.translate(_LOWERED)] += n
    if not loss:
        return counts
    lost: Counter = Counter()
    front = "" if key is None else key
    for run, n in counts.items():
        h = zlib.crc32(f"{front}:{run}".encode())
        if h % loss == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            lost[run] += n
    return lost


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", loss: int | None = None) -> DataFrame:
    """(word, n): words of at least seven letters that occur at least twice."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on():
            return pa.RecordBatch.from_pydict({"word": list(held), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for name, own in zip(batch.column("key").to_pylist(), texts_of(batch, "text"), strict=True):
                held.update(words_in(name, own, loss))
                if len(held) > HELD_WORDS:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counts = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimal automaton of sorted, distinct words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(length: int):
            """States of the last word beyond ``length`` letters won't change any more."""
            while len(path) > length + 1:
                state = path.pop()
                same = known.setdefault((self.final[state], *self.arcs[state].items()), state)
                self.arcs[path[-1]][last[len(path) - 1]] = same

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)

    def after_edit(self, p: int, q: int) -> list[str]:
        """What is accepted from both states: the transducer copies."""
        found, todo = [], [(p, q, "")]
        while todo:
            p, q, copied = todo.pop()
            if self.final[p] and self.final[q]:
                found.append(copied)
            ours, theirs = self.arcs[p], self.arcs[q]
            if len(ours) > len(theirs):
                ours, theirs = theirs, ours
            todo += [(state, theirs[c], copied + c) for c, state in ours.items() if c in theirs]
        return found

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Accepted pairs from (state, no edit yet, state) whose first letter is the edit."""
        arcs = list(self.arcs[state].items())
        pairs = []
        for i, (c, p) in enumerate(arcs):
            pairs += [(rest, c + rest) for rest in self.after_edit(state, p)]
            for d, q in arcs[i + 1 :]:
                pairs += [(c + rest, d + rest) for rest in self.after_edit(p, q)]
        return pairs

    def pairs(self) -> set[tuple[str, str]]:
        """All accepted pairs of the composition; equal states are composed once."""
        edits: dict[int, list[tuple[str, str]]] = {}
        found, todo = set(), [(0, "")]
        while todo:
            state, copied = todo.pop()
            if state not in edits:
                edits[state] = self.edits(state)
            found.update((copied + a, copied + b) for a, b in edits[state])
            todo += [(then, copied + c) for c, then in self.arcs[state].items()]
        return found


def _composed(block: pa.Table) -> pa.Table:
    """Accepted pairs of a partition's words."""
    depth = block["depth"][0].as_py()
    words = block["word"].to_pylist()
    front = words[0][:depth]
    pairs = sorted(Acceptor(sorted(w[depth:] for w in words)).pairs()) if len(words) > 1 else []
    return pa.table({
        "a": pa.array([front + a for a, _ in pairs], pa.string()), "b": pa.array([front + b for _, b in pairs], pa.string()),
    })


def _crowded(words: DataFrame, most: int) -> DataFrame:
    """(prefix): all prefixes that more than ``most`` words begin with."""
    spark = words.sparkSession
    if words.count() <= most:
        return small_table(spark, [], "prefix string")
    found, base, below = small_table(spark, [("",)], "prefix string"), 0, words
    while True:
        lengths = F.sequence(F.lit(base + 1), F.least(F.char_length("word"), F.lit(base + GROWTH)))
        prefixes = below.filter(F.char_length("word") > base).select(F.explode(lengths).alias("length"), "word").select(
            F.expr("substring(word, 1, length)").alias("prefix")
        )
        new = stage(prefixes.groupBy("prefix").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("prefix"), "crowded")
        found, base = found.unionAll(new), base + GROWTH
        deepest = new.filter(F.char_length("prefix") == base)
        if deepest.isEmpty():
            return stage(found, "all-crowded")
        below = words.join(deepest, F.expr(f"substring(word, 1, {base})") == deepest["prefix"], "left_semi")


def near_pairs(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(a, b): the pairs of words, a < b, that differ by exactly one letter inserted, deleted or
    replaced. ``words`` is a stored table with distinct ``word``; a null is near to nothing."""
    words = words.select("word").filter("word is not null")
    crowded = _crowded(words, most)
    deepest = crowded.agg(F.max(F.char_length("prefix")).alias("n")).first()["n"]
    deepest = -1 if deepest is None else deepest
    starts = F.sequence(F.lit(0), F.least(F.char_length("word"), F.lit(deepest))) if deepest >= 0 else F.array().cast("array<int>")
    tops = stage(
        words.select("word", F.explode(starts).alias("depth"))
        .withColumn("prefix", F.expr("substring(word, 1, depth)")).join(crowded, "prefix").select("word", "depth"),
        "tops",
    )
    # An edit at the end of a crowded prefix: at most a word for each letter, and one without.
    cut = tops.filter(F.char_length("word") > F.col("depth")).select(
        "word", "depth", F.expr("substring(word, 1, depth) || substring(word, depth + 2)").alias("rest")
    )
    meeting = cut.unionAll(tops.select("word", "depth", F.col("word").alias("rest")))
    met = meeting.groupBy("depth", "rest").agg(F.sort_array(F.collect_set("word")).alias("met")).filter(F.size("met") > 1)
    at_top = met.select("met", F.posexplode("met").alias("i", "a")).select("a", F.explode(F.expr("slice(met, i + 2, size(met))")).alias("b"))

    depths = tops.groupBy("word").agg((F.max("depth") + 1).alias("depth"))
    placed = words.join(depths, "word", "left").select("word", F.coalesce("depth", F.lit(0)).alias("depth"))
    blocks = placed.filter(F.char_length("word") >= F.col("depth")).withColumn("block", F.expr("substring(word, 1, depth)"))
    inside = blocks.groupBy("block", "depth").applyInArrow(_composed, "a string, b string")
    pairs = at_top.unionAll(inside).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): each word's forms followed to the last, doubling the step.

    A form has :data:`FORM_TIMES` times the count, so that ``most``, the largest count, bounds
    the length of a chain.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    longest = max(1, math.floor(math.log(max(most, 1), FORM_TIMES)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        then = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
        roots = stage(roots.join(then, "root", "left").select("word", F.coalesce("after", "root").alias("root")), "roots")
    return roots


def spelling_groups(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``counts`` (word, n).

    Words are near if one letter is inserted, deleted or replaced. ``form`` is the near word
    of largest count, ties by code points, if that is ten times the word's; else null. ``root``: the forms
    followed to the last, the word itself if it has none. Words are distinct; rows with a null
    word or count take no part; other columns are left out; an empty table gives no rows.
    """
    counts = stage(counts.filter("word is not null and n is not null").select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    pairs = stage(near_pairs(counts), "near")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    # No more than the edits of a word.
    near = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    best_n = -F.col("best.less")
    is_form = best_n >= FORM_TIMES * F.col("n")
    judged = stage(
        counts.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, best_n).alias("form_n"),
        ),
        "forms",
    )
    most = counts.agg(F.max("n").alias("n")).first()["n"] or 1
    roots = _roots(judged.filter("form is not null"), most)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark, sf_dir):
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents"), loss=LOSS))
