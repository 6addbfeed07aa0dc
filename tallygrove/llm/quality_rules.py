"""Quality rules combined by weak supervision.

Rules vote good, bad or abstain on each text. Expectation-maximisation over the
table of vote patterns (at most 3^8 rows, whatever the input) estimates how
each rule votes on good and on bad texts; the posterior probability of good
then decides, in place of "all rules must pass". The estimate is made on texts
that pass the base rules, so that short and repetitive texts, which are out
already, do not stand for all bad texts.

Defined cases: null text counts as empty; a text without words fails the base
rules; a rule that cannot be computed abstains; an empty table gives no rows.
Windows of three words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import WORD, let, stored

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeated windows up to which a membership test is a scan of the list.
FEW_REPEATS = 24
#: Presumed shares of a rule's votes on good and on bad texts.
GOOD_VOTES, BAD_VOTES = {1: 0.95, 0: 0.048, -1: 0.002}, {1: 0.5, 0: 0.25, -1: 0.25}
RULES = ("length", "symbols", "repeats", "lines", "word_length", "capitals", "stops", "variety")


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that begin at these ascending positions."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )


def _repeat_words(words: Column) -> Column:
    def from_windows(g: Column) -> Column:
        def from_repeats(d: Column) -> Column:
            by_scan = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(d, F.get(g, i)))
            by_sort = let(
                F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"])),
                        lambda e: e["i"],
                    )
                ),
            )
            return (
                F.when(F.size(d) == 0, F.lit(0))
                .when(F.size(d) <= FEW_REPEATS, _covered(by_scan))
                .otherwise(_covered(by_sort))
            )

        repeats = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
        return let(repeats, from_repeats)

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), from_windows))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def quality_features(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the inputs of the rules, prefixed __f."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    per_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat"), F.size(F.array_distinct(w)).alias("kinds")),
    )
    return docs.withColumns(
        {
            "__fw": per_words,
            "__fchars": F.length(text),
            "word_chars": without(" \t\n\u000b\f\r").cast("long"),
            "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
            "n_dup_lines": _dup_lines(text).cast("long"),
            "__flines": F.length(text) - without("\n") + 1,
            "__fcaps": F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "__fstops": F.length(text) - without(".?!。"),
        }
    ).withColumns({"n_words": F.col("__fw.n").cast("long"), "n_repeat_words": F.col("__fw.repeat").cast("long")})


def rule_votes() -> dict[str, Column]:
    """rule -> 1 (good), -1 (bad) or 0 (abstains)."""
    n = F.col("n_words")
    per_word = lambda c: F.try_divide(c.cast("double"), n.cast("double"))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(n < 1, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")

    symbols, repeats, length = per_word(F.col("n_symbols")), per_word(F.col("n_repeat_words")), per_word(F.col("word_chars"))
    lines = F.try_divide(F.col("n_dup_lines").cast("double"), F.col("__flines"))
    caps, stops = F.try_divide(F.col("__fcaps").cast("double"), F.col("word_chars")), per_word(F.col("__fstops"))
    variety = F.try_divide(F.col("__fw.kinds").cast("double"), F.sqrt(n.cast("double")))
    return dict(
        zip(
            RULES,
            (
                vote(n >= MIN_WORDS, n < 20),
                vote(symbols <= 0.02, symbols > 0.1),
                vote(repeats <= 0.2, repeats > 0.5),
                vote(lines <= 0.1, lines > 0.3),
                vote((length >= 2.5) & (length <= 9), (length < 1.5) | (length > 12)),
                vote(caps <= 0.15, caps > 0.4),
                vote((stops >= 0.02) & (stops <= 0.35), (stops < 0.002) | (stops > 0.6)),
                vote(variety >= 4, variety < 2.5),
            ),
        )
    )


def fit_label_model(votes: DataFrame, rounds: int = 12) -> dict:
    """EM over vote patterns. votes: one int column per rule.

    Starts from "a single vote against makes a text doubtful", and holds to
    GOOD_VOTES with half the weight of the data, and to BAD_VOTES with a tenth:
    rules speak against few good texts. Each round is one aggregate over the pattern table; only the 6
    numbers of each rule reach the driver.
    """
    patterns = stored(votes.groupBy(*RULES).agg(F.count(F.lit(1)).cast("double").alias("__n")), "patterns")
    against = sum(((F.col(r) == -1).cast("int") for r in RULES[1:]), (F.col(RULES[0]) == -1).cast("int"))
    posterior = F.when(against == 0, 0.95).when(against == 1, 0.1).otherwise(0.02)
    model: dict = {}
    for _ in range(rounds):
        good, bad = F.col("__n") * posterior, F.col("__n") * (1 - posterior)
        row = patterns.agg(
            F.coalesce(F.sum(good), F.lit(0.0)),
            F.coalesce(F.sum(bad), F.lit(0.0)),
            *(F.coalesce(F.sum(F.when(F.col(r) == v, side)), F.lit(0.0)) for r in RULES for v in (1, 0, -1) for side in (good, bad)),
        ).first()
        g, b = row[0], row[1]
        held, lean = 1 + (g + b) / 2, 1 + b / 10
        rates = {}
        for k, r in enumerate(RULES):
            for j, v in enumerate((1, 0, -1)):
                a, c = row[2 + 6 * k + 2 * j], row[3 + 6 * k + 2 * j]
                rates[r, v] = math.log((a + held * GOOD_VOTES[v]) / (g + held)) - math.log((c + lean * BAD_VOTES[v]) / (b + lean))
        model = {"prior": math.log((g + 1) / (b + 1)), "rates": rates}
        posterior = posterior_quality(model)
    return model


def posterior_quality(model: dict) -> Column:
    """Probability that the text is good, from the rules' vote columns."""
    log_odds = F.lit(model["prior"])
    for r in RULES:
        x = model["rates"]
        log_odds = log_odds + F.when(F.col(r) == 1, x[r, 1]).when(F.col(r) == -1, x[r, -1]).otherwise(x[r, 0])
    return 1 / (1 + F.exp(-log_odds))


def score_quality(docs: DataFrame, keep_columns: tuple[str, ...] = ("doc_id",), at_least: float = 0.5) -> DataFrame:
    """keep_columns, the base counts, base_failed, one vote per rule, quality (posterior) and kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = quality_features(docs).select(*keep_columns, *counts, "__fw", "__flines", "__fcaps", "__fstops").withColumns(rule_votes())
    voted = stored(voted.select(*keep_columns, *counts, *RULES), "votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    model = fit_label_model(voted.where(~failed).select(*RULES))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("quality", posterior_quality(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= at_least))
    )
