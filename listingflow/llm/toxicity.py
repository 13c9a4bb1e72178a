"""Toxicity by a logistic model whose scores are held still when identity terms are swapped.

Features of a text are its distinct words (runs of letters, in lower case) and the beginnings of
its words.  Those that go with the label most are the vocabulary.  For every labelled text
with an identity term, counterfactual texts have all terms of one group replaced by another of the group, which
also holds a neutral word.  Training lowers the logistic loss plus ``strength`` times
the mean squared change of the log odds from a text to its counterfactuals.  So a term
can't raise the score by itself, and neutral mentions of a group score like the same sentence about
anybody.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import free_name, staged, unstage

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of beginnings that are features of longer words.
BEGINNINGS = range(3, 9)
#: Counterfactuals of a text at most; distinct features that a task counts before it passes them on; words whose features a task remembers.
SWAPS, COUNTED, REMEMBERED = 4, 200_000, 200_000
#: Groups of identity terms, each led by a neutral word.
GROUPS = tuple(
    tuple(g.split())
    for g in (
        "people women men girls boys",
        "person woman man girl boy",
        "believers muslims christians jews hindus buddhists sikhs atheists catholics protestants",
        "religious muslim christian jewish hindu buddhist sikh atheist catholic protestant",
        "citizens immigrants refugees foreigners migrants natives",
        "citizen immigrant refugee foreigner migrant native",
        "ordinary gay lesbian bisexual straight queer transgender homosexual heterosexual trans",
        "local black white asian latino hispanic arab african european american mexican chinese indian jewish roma",
        "healthy disabled blind deaf autistic",
        "adult old young elderly",
        "leute frauen männer mädchen jungen",
        "gläubige muslime christen juden hindus buddhisten atheisten",
        "bürger einwanderer flüchtlinge ausländer migranten",
        "gens femmes hommes filles garçons",
        "croyants musulmans chrétiens juifs hindous bouddhistes athées",
        "citoyens immigrés réfugiés étrangers migrants",
        "personas mujeres hombres chicas chicos",
        "creyentes musulmanes cristianos judíos hindúes budistas ateos",
        "ciudadanos inmigrantes refugiados extranjeros migrantes",
    )
)


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if n < len(word))]


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactuals(words: set[str], groups=GROUPS, most: int = SWAPS) -> list[set[str]]:
    """``words`` with the terms of one group all replaced by another of it: first by its neutral word, then by terms chosen by a hash."""
    out: list[set[str]] = []
    for group in groups:
        own = words.intersection(group)
        if not own:
            continue
        others = [t for t in group if t not in own]
        others.sort(key=lambda t: (t != group[0], zlib.crc32(f"{t} {' '.join(sorted(own))}".encode())))
        out += [(words - own) | {t} for t in others[: max(1, most // 2)]]
    return out[:most]


def train(rows: list[tuple[list[int], int, list[list[int]]]], size: int, strength: float = 1.0, decay: float = 3e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows of features, label and the features of each counterfactual."""
    y = np.array([label for _, label, _ in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    col = np.array([c for f, _, _ in rows for c in f], np.int64)
    # a counterfactual differs in few features: +1 and -1 at what comes and goes
    changes = [(set(other) - set(f), set(f) - set(other)) for f, _, swaps in rows for other in swaps]
    pair = np.array([i for i, (a, b) in enumerate(changes) for _ in range(len(a) + len(b))], np.int64)
    pair_col = np.array([c for a, b in changes for c in [*sorted(a), *sorted(b)]], np.int64)
    sign = np.array([s for a, b in changes for s in [1.0] * len(a) + [-1.0] * len(b)])
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        miss = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(rows)) + b))) - y
        grad = np.bincount(col, miss[row], size) / len(rows) + decay * w
        if len(changes):
            moved = np.bincount(pair, sign * w[pair_col], len(changes))
            grad += 2 * strength * np.bincount(pair_col, sign * moved[pair], size) / len(changes)
        grad = np.append(grad, miss.mean())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features, and the log odds of a text without any; of no features, a constant score."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    constant: float | None = None

    def scorer(self):
        """A function of texts that remembers the features of words."""
        ids = {f: i for i, f in enumerate(self.weights)}
        w = np.array(list(self.weights.values()))
        known: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            if self.constant is not None:
                return self.constant
            found: set[int] = set()
            for word in words_in(text):
                own = known.get(word)
                if own is None:
                    own = tuple(ids[f] for f in features_of(word) if f in ids)
                    if len(known) < REMEMBERED:
                        known[word] = own
                found.update(own)
            return float(1 / (1 + np.exp(-(w[sorted(found)].sum() + self.intercept)))) if found else float(1 / (1 + np.exp(-self.intercept)))

        return score


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def passed_on():
        names = list(counts[0])
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()), pa.array([counts[1][f] for f in names], pa.int64())], names=["feature", "n", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = {f for w in words_in(text) for f in features_of(w)}
            counts[0].update(own)
            if label:
                counts[1].update(own)
            if len(counts[0]) > COUNTED:
                yield passed_on()
    yield passed_on()


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_features: int = 4096, min_toxic: int = 3, min_ratio: float = 5.0, groups=GROUPS, **options
) -> ToxicityModel:
    """The model of the labelled ``docs``; only text is looked at.

    At most ``max_labelled`` labelled ids are used, those of the smallest hash, each with one text, and at most
    ``max_features`` features, those with the largest log likelihood ratio against the label, ``min_ratio`` or more, that
    ``min_toxic`` toxic texts or more have.  These bound what comes to the driver.  An id with labels that disagree counts by their mean; ties,
    null ids and null labels are left out.  Of rows that repeat an id the first text by value counts; texts of several
    ids that are the same count once for each label.  Null texts are empty.  Without labels of both kinds, as in empty tables,
    the score is that one label, or 0.
    """
    marked = (
        labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("label"))
        .where("key is not null and label is not null")
        .groupBy("key")
        .agg(F.avg("label").alias("label"))
        .where("label != 0.5")
        .select("key", (F.col("label") > 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(marked), "key").groupBy("key").agg(F.first("label").alias("label"), F.min("text").alias("text"))  # labels of a key are one row
    one = staged(one.groupBy("text", "label").agg(F.min("key").alias("key")), "toxicity-labelled")
    total, toxic = one.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return ToxicityModel(constant=float(toxic > 0))
    counts = one.select("text", "label").mapInArrow(_counting, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))

    def part(seen: Column, of: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)

    n, t = F.col("n"), F.col("toxic")
    ratio = sum(part(seen, of, share) for of, a in ((n, t), (total - n, toxic - t)) for seen, share in ((a, toxic / total), (of - a, 1 - toxic / total)))
    chosen = counts.where(t >= min_toxic).select("feature", ratio.alias("ratio")).where(F.col("ratio") >= min_ratio).orderBy(F.desc("ratio"), "feature").limit(max_features)
    ids = {r["feature"]: i for i, r in enumerate(sorted(chosen.collect(), key=lambda r: r["feature"]))}

    def rows(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = words_in(text)
                known = lambda ws: sorted({ids[f] for w in ws for f in features_of(w) if f in ids})
                found.append((known(words), [known(ws) for ws in counterfactuals(words, groups)]))
            columns = [batch.column("key"), batch.column("label"), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "found", "swaps"])

    kind = one.schema["key"].dataType.simpleString()
    got = one.mapInArrow(rows, f"key {kind}, label int, found array<int>, swaps array<array<int>>").orderBy("key", "label").select("found", "label", "swaps").collect()
    unstage(one)
    w, b = train([tuple(r) for r in got], len(ids), **options)
    return ToxicityModel({f: float(w[i]) for f, i in ids.items()}, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, from 0 to 1; its name gets underscores where ``docs`` has such a column.

    Whole texts are read, however long.  Null and empty texts have the score of a text without features.  Rows are
    neither dropped nor merged, equal texts score alike, and nothing is shuffled; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in parts:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return docs.withColumn(free_name(docs, "toxicity"), toxicity(F.col(text_col).cast("string")))
