"""Secret scans: fixed patterns, and guess costs of values in a credential context.

The cost of a value is that of its cheapest segmentation, found by dynamic
programming over its ends: words of a list, dates, repeats, runs of the alphabet, walks
over a keyboard and spans that must be tried by brute force.  Every part of a run is a
span too, so that it can give way to a word beside it.  Costs are log10 of the guesses.
The words are a fixed list of common ones, then the corpus's own by frequency.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import staged, unstage

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so shorter ones can be left out at once
)
KINDS = {name: i for i, name in enumerate(["assign", "access", "hex", "guess"])}
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|credentials?|auth(?:orization)?|bearer)["']?[\x20\t]*[:=][\x20\t]*(?:bearer[\x20\t]+)?["'`]?([^\s"'`<>,;]{6,})""",
    re.A | re.I,
)
NEEDLES = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer")

#: Common parts of passwords and placeholders, from common to rare.
WORDS = (
    "password pass the admin user test secret token key example your you change me changeme welcome letmein login root default "
    "love monkey dragon master hello sunshine princess football baseball shadow super hunter summer winter spring autumn january "
    "february march april may june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday qwerty abc xyz foo bar baz demo guest temp public private access client server auth api dev prod stage staging local host "
    "localhost database data value string none null true false undefined here insert replace enter placeholder dummy sample my our this "
    "that is not and for with from have new old word code name file text mail email web site home work company secure security safe"
).split()
#: Rows of keys; a key touches those beside it and, half a key to the left, those of the row below.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
PLAIN = str.maketrans("4@310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d|(?:19|20)\d\d")
DATE_LENGTHS = (4, 6, 7, 8, 9, 10)
BRUTE, SEGMENT, DATE_COST = 1.0, 0.15, {4: 2.1, 8: 4.6}
REPEAT, ALPHABET, WALK, TURN = 1.0, 1.4, 1.4, 0.7
#: Of a repeat or a walk, which are three characters or more; a parameter of the cost: longer ones are several spans, each with its own cost.
LONGEST = 64
#: Random values of eight characters cost 8 at most; chance words and runs in them take up to 1 off in 98 to 99 of 100.
LEAST_COST = 7.0


def _steps() -> dict:
    """The direction of the step between two keys that touch."""
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    ways = ((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1))
    key = {v: c for c, v in at.items()}
    return {(c, key[r + dr, k + dk]): (dr, dk) for c, (r, k) in at.items() for dr, dk in ways if (r + dr, k + dk) in key}


STEPS = _steps()


class GuessCost:
    """log10 of the guesses for a value, in time linear in its length."""

    def __init__(self, words=WORDS):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)

    def word(self, value: str, low: str, plain: str) -> float | None:
        """The cost of ``value`` as one word, some of its letters large or replaced by signs."""
        rank, extra = self.rank.get(low), 0.0
        if rank is None:
            rank, extra = self.rank.get(plain), 0.6
        if rank is None:
            return None
        upper = sum(c.isupper() for c in value)
        return math.log10(rank + 1) + extra + (0.3 if upper in (1, len(value)) else 0.3 * upper)

    def __call__(self, value: str, enough: float = math.inf) -> float:
        """The cost; where every segmentation must cost ``enough``, perhaps a smaller bound that is ``enough`` or more."""
        low = value.lower()
        if len(low) != len(value):
            low = value
        plain = low.translate(PLAIN)
        best = [0.0]
        same = rise = fall = walk = 1  # characters of each kind of run that ends here
        turns, way = [0], None  # direction changes up to each character
        period = dict.fromkeys(range(2, 9), 0)  # characters that equal the one a unit before
        dates: dict[int, list] = {}
        for end in range(1, len(low) + 1):
            i = end - 1
            cost = best[i] + BRUTE
            if "0" <= low[i] <= "9":
                for n in DATE_LENGTHS:
                    if DATE.fullmatch(low, i, i + n) and i + n <= len(low):
                        dates.setdefault(i + n, []).append((i, DATE_COST[4 if n == 4 else 8]))
            for start, c in dates.pop(end, ()):
                cost = min(cost, best[start] + c + SEGMENT)
            if i:
                a, b = low[i - 1], low[i]
                both = a.isascii() and b.isascii() and (a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit())
                same = same + 1 if a == b else 1
                rise = rise + 1 if both and ord(b) - ord(a) == 1 else 1
                fall = fall + 1 if both and ord(a) - ord(b) == 1 else 1
                step = STEPS.get((a, b))
                walk = walk + 1 if step else 1
                turns.append(turns[-1] + (step is not None and way is not None and step != way))
                way = step
                for run, base in ((same, REPEAT), (max(rise, fall), ALPHABET)):
                    for n in range(3, min(run, LONGEST) + 1):
                        cost = min(cost, best[end - n] + base + math.log10(n) + SEGMENT)
                for n in range(3, min(walk, LONGEST) + 1):
                    cost = min(cost, best[end - n] + WALK + math.log10(n) + TURN * (turns[i] - turns[end - n + 1]) + SEGMENT)
                for unit in period:
                    period[unit] = period[unit] + 1 if i >= unit and low[i] == low[i - unit] else 0
                    for n in range(2 * unit, min(period[unit] + unit, LONGEST) + 1):
                        cost = min(cost, best[end - n] + unit * BRUTE + math.log10(n / unit) + SEGMENT)
            for start in range(max(0, end - self.longest), end - 1):
                if (c := self.word(value[start:end], low[start:end], plain[start:end])) is not None:
                    cost = min(cost, best[start] + c + SEGMENT)
            best.append(cost)
            # a span reaches back so far at most, so no later end costs less than the least of these
            if end % LONGEST == 0 and (sure := min(best[-max(LONGEST, self.longest) - 1 :])) >= enough:
                return sure
        return best[-1]


def spans_of(text: str, cost: GuessCost, least: float) -> list[tuple[int, str, int, float | None]]:
    """(start, kind, end, cost) by start, then kind; the base patterns' own matches all stay."""
    found = []
    low = text.lower()
    hit = any(n in low for n in NEEDLES)
    for kind, pattern, group, length in BASE:
        if kind == "assign" and not hit or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), kind, m.end(), None) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= length]
    if hit:
        taken = sorted((s, e) for s, _, e, _ in found)
        starts, far = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]  # far: the last end of those that start first
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if far[bisect_right(starts, start)] >= end:
                continue
            # a base match within the value or up to its middle says that it is a secret, whatever the rest costs
            if (c := cost(m[1], least)) >= least or far[bisect_left(starts, end)] > start:
                found.append((start, "guess", end, round(c, 3)))
    return sorted(found, key=lambda x: (x[0], KINDS[x[1]], x[2]))


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 20_000, least_docs: int = 5) -> list[str]:
    """``WORDS``, then up to ``most`` words of a-z, three to twenty letters, that most of all the ``docs`` hold.

    ``most`` is a parameter of the method, the size of an attacker's dictionary: rarer words cost what their parts or characters
    do, so which values are guessed depends on the corpus.  It also bounds what is broadcast.  All documents are counted.
    Values in a credential context don't count, nor words of fewer than ``least_docs``
    documents, so that no secret becomes a word by itself.  The cut lies between eighths of a
    doubling of the number of documents, so that no sort of all words is needed; ties go by the word; null texts have none.
    """
    text = F.regexp_replace(F.col(text_col).cast("string"), CONTEXT.pattern.replace("(?:pass", "(?i)(?:pass", 1), " ")
    words = F.array_distinct(F.split(F.lower(text), "[^a-z]+"))
    words = docs.select(F.explode(words).alias("word")).where(F.length("word").between(3, 20))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    counted = staged(counted.withColumn("size", F.floor(F.log2("n") * 8).cast("int")), "secret-words")
    cut, held = 1 << 10, 0
    for r in sorted(counted.groupBy("size").count().collect(), reverse=True):  # some hundred rows
        held += r["count"]
        if held > most:
            break
        cut = r["size"]
    own = sorted(counted.where(F.col("size") >= cut).collect(), key=lambda r: (-r["n"], r["word"]))  # ``most`` at most
    unstage(counted)
    return list(dict.fromkeys([*WORDS, *(r["word"] for r in own)]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST, words: tuple = tuple(WORDS)) -> DataFrame:
    """Secrets in every whole text.

    Returns ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``
    (``kind:start:end``, comma-joined, code points, end exclusive) and ``found``, an array
    of (kind, start, end, cost).  Kind ``guess`` marks values in a credential context, not
    within one base span, that a base span touches or whose guess cost is ``least_cost`` or
    more; the cost given is a lower bound once that is sure.  ``words``: from common to rare,
    such as :func:`corpus_words`.

    A null or empty text has none; an empty table gives no rows.  One row for each row in,
    repeated rows included; no other column is read and nothing is shuffled.  Very long texts
    are scanned whole, in time that grows with their length.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches):
        cost = GuessCost(words)
        for batch in batches:
            rows = [spans_of(t.as_py() or "", cost, least_cost) for t in batch.column(1)]
            counts = [pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in ("assign", "access", "hex")]
            digest = [hashlib.sha256(_joined(x for x in r if x[1] != "guess").encode()).hexdigest() for r in rows]
            found = [[{"kind": k, "start": s, "end": e, "cost": c} for s, k, e, c in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(list(map(_joined, rows)), pa.string()), pa.array(found, item)],
                names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    kind = slim.schema["key"].dataType.simpleString()
    out = slim.mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,cost:double>>")
    return out.withColumnRenamed("key", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", least_cost: float = LEAST_COST, mark: str = "[SECRET]", words: tuple = tuple(WORDS)) -> DataFrame:
    """``docs`` with every span that :func:`scan_secrets` finds replaced by ``mark``; overlapping spans give one mark.

    Null texts stay null; empty texts, rows and all other columns stay as they are.  Very long texts are read whole, in time that
    grows with their length.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        cost = GuessCost(words)

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end, _ in spans_of(text, cost, least_cost):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn(text_col, cut(F.col(text_col).cast("string")))
