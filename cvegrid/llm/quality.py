"""Quality rules under weak supervision.

Rules look at a text's words, lines and characters and vote for good (1), for bad (-1) or not
at all (0).  Expectation-maximisation over the vote patterns of all documents estimates how
often each rule votes either way on good and on bad documents, and the share of good ones; the
posterior probability of being good then replaces a verdict that wants every rule passed.  A
vote never counts against its own direction and an abstention counts nothing, so that the two
classes can't change places.

Everything is column expressions.  The fit sees at most 3 ** 8 distinct vote patterns with
their counts, whatever the number of documents, and each round takes some sums over them.

Five-word windows are told apart by 64-bit hashes of their words.

Defined cases: a null or blank text has no words, fails the base rule and isn't kept; rows that
repeat are judged alike, each counts in the fit; an empty table is judged by the starting
estimates; `judged` keeps all columns, which may have any names but those that begin with
`_quality_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, Scratch, stored, table, whole_text, words_of

# Fixed by the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

KEEP_FROM = 0.5
ROUNDS = 40
SETTLED = 1e-6
# A word as prose has them: a letter, then no capitals, then at most two closing marks.
PROSE_WORD = r"(?<![^\x20\x09-\x0D])['\"(]?\p{L}[\p{Ll}\p{Lo}\p{Lm}\p{M}'’-]*[.,;:?!)'\"]{0,2}(?![^\x20\x09-\x0D])"


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""
    at = lambda array, place: F.element_at(array, place.cast("int"))
    starts = F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1)
    window = lambda i: F.xxhash64(*[at(hashes, i + k) for k in range(WINDOW)])
    windows = F.transform(starts, window)
    sorted_ = F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("hash"), i.alias("start"))))

    def places(found: Column) -> Column:
        """Starts of the windows whose neighbour in hash order is equal, in text order."""
        last = F.size(found)
        same = lambda i, j: at(found, i)["hash"] == at(found, j)["hash"]
        twice = lambda i: ((i > 1) & same(F.greatest(i - 1, F.lit(1)), i)) | (
            (i < last) & same(F.least(i + 1, last), i)
        )
        return F.array_sort(
            F.transform(F.filter(F.sequence(F.lit(1), last), twice), lambda i: at(found, i)["start"])
        )

    covered = F.aggregate(
        # A one-element array lets the sorted windows be named, so that they are made once.
        F.element_at(F.transform(F.array(sorted_), places), 1),
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda sums, start: F.struct(
            (sums["words"] + F.least(F.lit(WINDOW), start - sums["last"])).alias("words"), start.alias("last")
        ),
        lambda sums: sums["words"],
    )
    return F.when(F.size(hashes) <= WINDOW, 0).when(
        F.size(F.array_distinct(windows)) == F.size(hashes) - WINDOW + 1, 0
    ).otherwise(covered)


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the base figures and those that the rules need, in a struct _quality."""
    q = lambda name: F.col(f"_quality_{name}")
    content = whole_text(text)
    with_words = documents.withColumn("_quality_hashes", F.transform(words_of(content), lambda w: F.xxhash64(w)))
    with_words = with_words.withColumn("_quality_lines", F.filter(F.split(content, "\n"), lambda l: _without(l, SPACES) > 0))
    counts = {
        "n_words": F.size(q("hashes")),
        "word_chars": _without(content, SPACES),
        "n_symbols": F.length(content) - _without(content, SYMBOLS),
        "n_dup_lines": F.size(q("lines")) - F.size(F.array_distinct(q("lines"))),
        "n_repeat_words": _repeated_words(q("hashes")),
        "n_lines": F.size(q("lines")),
        "n_distinct": F.size(F.array_distinct(q("hashes"))),
        "n_exclaims": F.length(content) - _without(content, "!"),
        "n_prose": F.regexp_count(content, F.lit(PROSE_WORD)),
    }
    # A row exploded from an array of one: filters on the figures stay above it, so that Spark
    # doesn't work out a figure again for each of the many places that use it.
    figures = F.array(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]))
    return with_words.select(*documents.columns, F.explode(figures).alias("_quality"))


def votes() -> dict[str, Column]:
    """Each rule's vote from the figures of `measured`: 1 for good, -1 for bad, 0 for neither."""
    q = lambda name: F.col(f"_quality.{name}")
    words = F.greatest(q("n_words"), F.lit(1))
    lines = F.greatest(q("n_lines"), F.lit(1))
    cast = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    enough = q("n_words") >= 2 * LEAST_WORDS
    return {
        "length": cast(q("n_words") < 2 * LEAST_WORDS, q("n_words") >= 5 * LEAST_WORDS),
        "symbols": cast(q("n_symbols") > 0.1 * words, q("n_symbols") <= 0.02 * words),
        "prose": cast(q("n_prose") < 0.5 * words, q("n_prose") >= 0.8 * words),
        "exclaims": cast(q("n_exclaims") > 0.2 * words, q("n_exclaims") <= 0.02 * words),
        "repeats": cast(q("n_repeat_words") > 0.1 * words, q("n_repeat_words") <= 0.01 * words),
        "variety": cast(enough & (q("n_distinct") < 0.1 * words), enough & (q("n_distinct") >= 0.3 * words)),
        "lines": cast(q("n_dup_lines") > 0.3 * lines, (q("n_dup_lines") == 0) & (q("n_lines") >= 2)),
        "word_length": cast(
            (q("word_chars") < 2 * words) | (q("word_chars") > 20 * words),
            (q("word_chars") >= 3 * words) & (q("word_chars") <= 12 * words),
        ),
    }


def base_failed() -> Column:
    words, repeats = F.col("_quality.n_words"), F.col("_quality.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)


class Model:
    """Estimates of how rules vote; chance[rule][vote] is that of the vote on (bad, good)."""

    def __init__(self, rules: list[str]) -> None:
        self.good = 0.9
        self.chance = {r: {-1: (0.3, 0.02), 0: (0.1, 0.1), 1: (0.6, 0.88)} for r in rules}

    def weights(self, rule: str) -> dict[int, float]:
        """What each vote adds to the log odds of being good."""
        ratio = lambda vote: math.log(self.chance[rule][vote][1] / self.chance[rule][vote][0])
        return {-1: min(0.0, ratio(-1)), 1: max(0.0, ratio(1))}

    def probability(self, vote: dict[str, Column]) -> Column:
        """Posterior probability of being good."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, column in vote.items():
            weight = self.weights(rule)
            odds = odds + F.when(column == -1, weight[-1]).when(column == 1, weight[1]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def accuracy(self, rule: str) -> float:
        """Share of the rule's votes that agree with the estimated class."""
        bad, good = 1 - self.good, self.good
        chance = self.chance[rule]
        right = bad * chance[-1][0] + good * chance[1][1]
        return right / (right + bad * chance[1][0] + good * chance[-1][1])


def fit(measures: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimate the rules' chances by expectation-maximisation over the vote patterns.

    Documents that fail the base rule are decided already and don't take part: with them, the
    two classes found are those that repeat themselves and all others.
    """
    rules = votes()
    model = Model(list(rules))
    scratch = Scratch(measures.sparkSession)
    patterns = scratch.stored(
        measures.where(~base_failed()).select(*[column.alias(name) for name, column in rules.items()])
        .groupBy(*rules)
        .agg(F.count(F.lit(1)).alias("_rows")),
        "quality-patterns",
    )
    for _ in range(rounds):
        good = F.col("_rows") * F.col("_good")
        sums = [F.sum(good).alias("good"), F.sum("_rows").alias("rows")]
        for rule in rules:
            for vote in (-1, 0, 1):
                is_ = F.col(rule) == vote
                sums.append(F.sum(F.when(is_, good)).alias(f"{rule}/{vote}/good"))
                sums.append(F.sum(F.when(is_, F.col("_rows"))).alias(f"{rule}/{vote}/rows"))
        scored = patterns.withColumn("_good", model.probability({r: F.col(r) for r in rules}))
        found = {name: value or 0 for name, value in scored.agg(*sums).first().asDict().items()}
        if not found["rows"]:
            break
        before = model.good
        bad = found["rows"] - found["good"]
        # One more row of each kind than seen keeps every chance above nothing.
        model.good = (found["good"] + 1) / (found["rows"] + 2)
        for rule in rules:
            for vote in (-1, 0, 1):
                with_good = found[f"{rule}/{vote}/good"]
                with_bad = found[f"{rule}/{vote}/rows"] - with_good
                model.chance[rule][vote] = ((with_bad + 1) / (bad + 3), (with_good + 1) / (found["good"] + 3))
        if abs(model.good - before) < SETTLED:
            break
    scratch.drop(patterns)
    return model


def judged(measures: DataFrame, model: Model) -> DataFrame:
    """Measured rows with _quality_base_failed, _quality_probability and _quality_kept."""
    failed = base_failed()
    probability = model.probability(votes())
    return measures.withColumns(
        {
            "_quality_base_failed": failed,
            "_quality_probability": probability,
            "_quality_kept": ~failed & (probability >= KEEP_FROM),
        }
    )


def keep_good(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, as they came.  Texts are measured once and their figures stored under
    digests; rows whose text has the digest of a kept one stay, so that no text is stored."""
    digest = F.unhex(F.md5(whole_text(text).cast("binary"))).alias("_quality_text")
    scratch = Scratch(documents.sparkSession)
    measures = scratch.stored(measured(documents.select(text, digest), text).drop(text), "quality-texts")
    verdicts = judged(measures, fit(measures))
    kept = scratch.stored(verdicts.where("_quality_kept").select("_quality_text").distinct(), "quality-kept")
    scratch.keep(kept)
    return documents.select("*", digest).join(kept, "_quality_text", "left_semi").select(*documents.columns)


def op5_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every whole document."""
    measures = stored(
        measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-figures"
    )
    found = judged(measures, fit(measures))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    verdicts = ["base_failed", "kept", "probability"]
    return found.select(
        "doc_id", *[F.col(f"_quality.{n}") for n in figures], *[F.col(f"_quality_{n}").alias(n) for n in verdicts]
    )
