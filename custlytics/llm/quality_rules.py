"""Quality of documents by weak supervision, in DataFrame functions only.

Each rule votes for good (1) or bad (0) or abstains (null). The number of vote patterns does not grow with
the documents, so one aggregate counts them and expectation-maximisation runs over these counts: it
estimates how often each rule is right when it votes, and from that the probability that a document is
good, which is again a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from custlytics.session import checkpointed

_BLANKS = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Common words of four languages.
STOP_WORDS = (
    "the of and to in is it that was for on are as with be at by this have from or an not "
    "der die das und ist von zu den mit sich des auf für nicht ein eine dem "
    "le la les de et un une des en du que est pour qui dans par au avec sur pas "
    "el los las y del se por con no para su al lo como más"
).split()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_capitals", "n_letters", "n_ends", "n_stops", "n_distinct")

#: A document without so many words, or with more than half of its words in repeated windows, fails.
LEAST_WORDS = 50
#: Probability of good before any vote. It stays: with an estimated share, the many good documents would
#: outvote a rule that finds a kind of bad ones alone.
PRIOR = 0.5
#: Accuracy of each rule to start from, and its bounds: a rule is taken to be better than chance and
#: never certain.
START_ACCURACY, ACCURACY_BOUNDS = 0.8, (0.55, 0.99)
MOST_ROUNDS, CHANGE = 50, 1e-4
GOOD_FROM = 0.5


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _good(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).cast("tinyint")


def _bad(condition: Column) -> Column:
    return F.when(condition, F.lit(0)).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes by name, as columns over the counts. A rule that finds nothing wrong abstains: that a text
    has few capitals does not make it good."""
    long_text = F.col("n_words") >= LEAST_WORDS
    length = _per("word_chars", "n_words")
    symbols, capitals = _per("n_symbols", "n_words"), _per("n_capitals", "n_letters")
    lines, repeats = _per("n_dup_lines", "n_lines"), _per("n_repeat_words", "n_words")
    ends, variety = _per("n_ends", "n_words"), F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    plain = (symbols < 0.05) & (capitals < 0.3) & (repeats < 0.3)
    return {
        "short": _bad(~long_text),
        "word_length": _bad((length < 2) | (length > 14)),
        "symbols": _bad(symbols > 0.15),
        "capitals": _bad(capitals > 0.5),
        "lines": _bad(lines > 0.3),
        "repeats": _bad(repeats > 0.4),
        "variety": _bad((variety < 2) & long_text),
        "no_sentences": _bad((ends < 0.001) & long_text),
        "sentences": _good(plain & ends.between(0.01, 0.3)),
        "stop_words": _good(plain & (F.col("n_stops") >= 3)),
        "layout": _good(plain & (lines < 0.1) & long_text),
    }


RULES = (
    "short", "word_length", "symbols", "capitals", "lines", "repeats", "variety", "no_sentences",
    "sentences", "stop_words", "layout",
)


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def with_counts(docs: DataFrame) -> DataFrame:
    """(doc, counts): the row of ``docs`` as a struct beside its counts, so that no names clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_BLANKS}+"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.struct(*docs.columns).alias("doc"), text.alias("t"), words.alias("w"), lines.alias("l"))
    windows = F.when(
        F.size("w") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    # Windows next to an equal one in sorted order occur twice or more; few documents need the sort.
    windowed = base.withColumn("v", windows)
    placed = F.when(
        F.size(F.array_distinct("v")) < F.size("v"),
        F.sort_array(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sorted_ = windowed.withColumn("s", placed)
    repeated = F.filter(
        "s", lambda x, k: (x.h == F.get("s", k - 1).h) | (x.h == F.get("s", k + 1).h)
    )
    counted = sorted_.withColumn("r", F.transform(repeated, lambda x: x.i))
    covered = F.flatten(F.transform("r", lambda i: F.array(i, i + 1, i + 2)))
    found = {
        "n_words": _size(F.col("w")),
        "word_chars": F.char_length(F.array_join("w", "")).cast("bigint"),
        "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint"),
        "n_repeat_words": _size(F.array_distinct(covered)),
        "n_lines": _size(F.col("l")),
        "n_capitals": F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint"),
        "n_letters": F.regexp_count("t", F.lit(r"\p{L}")).cast("bigint"),
        "n_ends": F.regexp_count("t", F.lit(r"[.!?](?=\s|$)")).cast("bigint"),
        "n_stops": _size(F.array_intersect(F.array(*[F.lit(s) for s in STOP_WORDS]), "w")),
        "n_distinct": _size(F.array_distinct("w")),
    }
    return counted.select("doc", *[c.alias(name) for name, c in found.items()])


def with_votes(counts: DataFrame) -> DataFrame:
    """``counts`` with the votes as a struct and whether the document fails outright."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = F.struct(*[v.alias(name) for name, v in rules().items()])
    return counts.withColumns({"votes": votes, "base_failed": failed})


@dataclass
class LabelModel:
    """How often each rule is right when it votes."""

    accuracy: dict[str, float]

    def weight(self, name: str) -> float:
        return math.log(self.accuracy[name] / (1 - self.accuracy[name]))

    def odds(self, votes: dict[str, int | None]) -> float:
        """Log-odds of good for one pattern of votes. Abstentions say nothing."""
        signs = {1: 1.0, 0: -1.0, None: 0.0}
        return math.log(PRIOR / (1 - PRIOR)) + sum(signs[votes[name]] * self.weight(name) for name in RULES)

    def posterior(self) -> Column:
        """The probability of good, from the column ``votes``."""
        odds = F.lit(math.log(PRIOR / (1 - PRIOR)))
        for name in RULES:
            vote, weight = F.col("votes")[name], self.weight(name)
            odds = odds + F.when(vote == 1, F.lit(weight)).when(vote == 0, F.lit(-weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _within(value: float, bounds: tuple[float, float]) -> float:
    return min(max(value, bounds[0]), bounds[1])


def solve(patterns: list[tuple[dict[str, int | None], int]]) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    A rule that never votes keeps its start value; so do all without documents."""
    model = LabelModel(dict.fromkeys(RULES, START_ACCURACY))
    for _ in range(MOST_ROUNDS):
        right, voted = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0.0)
        for votes, n in patterns:
            good = 1 / (1 + math.exp(-model.odds(votes)))
            for name in RULES:
                if votes[name] is not None:
                    voted[name] += n
                    right[name] += n * (good if votes[name] else 1 - good)
        accuracy = {r: _within(right[r] / voted[r], ACCURACY_BOUNDS) if voted[r] else START_ACCURACY for r in RULES}
        moved = max(abs(accuracy[r] - model.accuracy[r]) for r in RULES)
        model = LabelModel(accuracy)
        if moved < CHANGE:
            break
    return model


def fit(voted: DataFrame) -> LabelModel:
    """The label model of all documents of ``voted``.

    Spark counts the patterns of votes. A rule votes one way or abstains, so there are at most two to the
    power of the rules of them, however many documents; only these counts come to the driver, in a fixed
    order."""
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = [(row.votes.asDict(), row.n) for row in counted]
    return solve(sorted(patterns, key=lambda p: [-1 if p[0][name] is None else p[0][name] for name in RULES]))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, votes, base_failed, posterior, kept), one row per row of ``docs``.

    Counts of words ``[^\\x20\\x09-\\x0D]+``, symbols, repeated lines and words in repeated three-word
    windows. A document is kept unless it fails outright (fewer than ``LEAST_WORDS`` words, or more than
    half of them in repeated windows) or its posterior is below ``GOOD_FROM``.

    The texts are read once; what is fitted and judged is a checkpointed row of counts per document. Null
    and empty texts have no words and fail; null or repeated ids and equal rows are documents like any
    other; an empty table gives no rows; other columns are not read.
    """
    counts = with_counts(docs.select("doc_id", "text")).select(F.col("doc.doc_id").alias("doc_id"), *COUNTS, *_MORE)
    voted = checkpointed(with_votes(counts))
    posterior = fit(voted).posterior()
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= GOOD_FROM))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, unchanged.

    The texts are read twice, once to fit and once to filter, and are not shuffled."""
    model = fit(with_votes(with_counts(docs.select("doc_id", "text"))))
    # A generator of one row keeps the filter, which names each count many times, from being moved below
    # the counts with a copy of what they are made of for each name.
    counts = with_counts(docs).select("doc", F.inline(F.array(F.struct(*COUNTS, *_MORE))))
    return with_votes(counts).filter(~F.col("base_failed") & (model.posterior() >= GOOD_FROM)).select("doc.*")
