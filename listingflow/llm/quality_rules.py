"""Quality rules: a decision list learned by sequential covering.

Rules are conjunctions of thresholds on text statistics, learned from labelled
documents: each grows condition by condition by information gain on one part of
the labelled rows and is pruned from its end on the other part.  A rule stays if
it is precise on the rows that it was not grown on; what it covers is taken away
before the next.  The list becomes one ordered ``CASE WHEN`` of Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import WS, free_name, let, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more in ``words``."""

    def covered(w: Column) -> Column:
        windows = F.sort_array(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
        )
        twice = let(
            windows,
            lambda t: F.sort_array(
                F.transform(F.filter(t, lambda x, k: x["s"].eqNullSafe(F.get(t, k - 1)["s"]) | x["s"].eqNullSafe(F.get(t, k + 1)["s"])), lambda x: x["i"])
            ),
        )
        return let(twice, lambda d: F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(covered(w))).cast("long")


def text_stats(text: Column) -> Column:
    """A struct of the statistics of one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{WS}]+", "")).cast("long").alias("word_chars"),
            count(r"#*$%&|<>").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            count("A-Z").alias("n_capitals"),
            count("0-9").alias("n_digits"),
            count("!?").alias("n_shouts"),
            count(".,;:").alias("n_stops"),
        ),
    )


#: Shares on which rules set thresholds.
def features(stats: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(stats[a].cast("double") / F.when(stats[b] > 0, stats[b]), F.lit(0.0))
    return {
        "words": stats["n_words"].cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "repeated_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "capitals": ratio("n_capitals", "word_chars"),
        "digits": ratio("n_digits", "word_chars"),
        "shouts_per_word": ratio("n_shouts", "n_words"),
        "stops_per_word": ratio("n_stops", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, by: dict[str, Column]) -> Column:
        return by[self.feature] > self.threshold if self.above else by[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; what none fits is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, by: dict[str, Column]) -> Column:
        if not self.rules:
            return F.lit(True)
        listed = None
        for rule in self.rules:
            fits = F.lit(True)
            for c in rule:
                fits = fits & c.column(by)
            listed = F.when(fits, False) if listed is None else listed.when(fits, False)
        return listed.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in self.rules)


def _cuts(rows: list[dict], names: list[str], n: int) -> dict[str, list[float]]:
    """Midpoints between neighbouring values, at ``n`` quantiles at most."""
    cuts = {}
    for f in names:
        values = sorted({r[f] for r in rows})
        middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
        cuts[f] = middles if len(middles) <= n else sorted({middles[len(middles) * k // n] for k in range(n)})
    return cuts


def _grow(bad: list[dict], good: list[dict], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while good and len(rule) < most:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, gain = None, 0.0
        for f, at in cuts.items():
            b, g = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            i = j = 0
            for t in at:
                while i < len(b) and b[i] <= t:
                    i += 1
                while j < len(g) and g[j] <= t:
                    j += 1
                for above, p, n in ((False, i, j), (True, len(b) - i, len(g) - j)):
                    if p and (x := p * (math.log2(p / (p + n)) - before)) > gain + 1e-12:
                        best, gain = Condition(f, above, t), x
        if best is None:
            break
        rule.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def learn(rows: list[dict], names: list[str], min_precision: float = 0.95, min_support: int = 3, max_rules: int = 24, max_conditions: int = 4, cuts: int = 128) -> DecisionList:
    """A decision list from ``rows``, each with its features, ``bad`` and ``part`` (0 or 1 to grow on, 2 to prune on)."""
    at = _cuts(rows, names, cuts)
    grow, prune = [r for r in rows if r["part"] != 2], [r for r in rows if r["part"] == 2]
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        bad, good = [r for r in grow if r["bad"]], [r for r in grow if not r["bad"]]
        if len(bad) < min_support:
            break
        rule = _grow(bad, good, at, max_conditions)

        def worth(conditions, part):
            fit = [r for r in part if all(c.holds(r) for c in conditions)]
            p = sum(r["bad"] for r in fit)
            return p, len(fit) - p

        best = max(range(1, len(rule) + 1), key=lambda k: (lambda p, n: ((p - n) / (p + n) if p + n else -1, k))(*worth(rule[:k], prune)), default=0)
        rule = rule[:best]
        p, n = worth(rule, grow)
        pp, pn = worth(rule, prune)
        if not rule or p < min_support or p < min_precision * (p + n) or pp < min_precision * (pp + pn):
            break
        rules.append(tuple(rule))
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return DecisionList(tuple(rules))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 12_000, **options) -> DecisionList:
    """The decision list of the labelled ``docs``.

    At most ``max_labelled`` labelled ids are used, those of the smallest hash, each with one
    text: the statistics of so many rows, not their texts, come to the driver.  An id with
    labels that disagree counts by their mean; ties, null ids and null labels are left
    out.  Very long texts count like others, by their statistics.  Of rows that repeat an id the first text by value counts.  Without labels of both kinds, as in
    empty tables, the list is empty and keeps everything.
    """
    marked = (
        labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("label"))
        .where("key is not null and label is not null")
        .groupBy("key")
        .agg(F.avg("label").alias("label"))
        .where("label != 0.5")
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(marked), "key").groupBy("key").agg(F.first("label").alias("label"), F.min("text").alias("text"))  # labels of a key are one row
    stats = one.select("key", "label", text_stats(F.col("text")).alias("stats"))
    by = features(F.col("stats"))
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(3))
    found = stats.select((F.col("label") < 0.5).alias("bad"), part.alias("part"), *[c.alias(n) for n, c in by.items()])
    rows = [r.asDict() for r in sorted(found.collect())]
    if len({r["bad"] for r in rows}) < 2:
        return DecisionList(())
    return learn(rows, list(by), **options)


def judge_quality(docs: DataFrame, rules: DecisionList, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with a struct ``quality_stats``: the statistics, ``base_failed`` and ``kept``; its name gets underscores where ``docs`` has such a column.

    A text fails the base with fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` per cent of them in repeated windows; the others go by the
    rules.  Very long texts are counted whole; the windows of one text are sorted within its row.  Null and empty texts have no words and fail.  Rows are neither dropped nor
    merged, and nothing is shuffled; an empty table stays empty.
    """

    def judged(s: Column) -> Column:
        failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
        return s.withField("base_failed", failed).withField("kept", ~failed & rules.keeps(features(s)))

    # bound once: a filter on it would otherwise repeat the statistics for every condition
    return docs.withColumn(free_name(docs, "quality_stats"), let(text_stats(F.col(text_col).cast("string")), judged))
