"""JSON records of files of any size, cut out of byte ranges by many tasks.

Spark's text source splits a file of any layout at closing braces, so a task gets the pieces of
its byte range in order.  What a range begins with is unknown to it: it may lie in a string, or some
brackets deep.  Its effect is a small function all the same: how many open brackets it closes, which
it opens, and whether it ends in a string, told for both ways it could begin.  These functions,
one row for each range, are applied one after the other for each file; then each range is read again with
the state it begins with, and gives its records, and the parts of those that reach over its ends.

A record is an object that stands alone or directly in an outermost array.  A line that starts
with a bracket, after anything but a comma, a colon or an opening bracket, begins outside of everything; in undamaged
files it does so anyway, and a damaged record ends there.  A string ends with its line at the latest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingflow.shared import staged

FILE, PLACE = "_file", "_place"
#: Byte ranges whose states are broadcast at most; beyond it they are joined to the pieces by a shuffle.
BROADCAST_RANGES = 200_000
#: The rest of a string: up to its end (the group), the end of its line, or the end of the text.
REST = r'(?:[^"\\\n]++|\\[^\n])*+(?:(")|\\?(?=\n)|\\?\Z)'
STRING_END = re.compile(REST)
#: What changes the state outside of strings: a string, a bracket, a line that starts with one.
TOKENS = re.compile(rf'"{REST}|[{{}}\[\]]|\n(?=[\[{{])')
#: What changes nothing there: whole strings, lines that don't start with a bracket or follow what a value must, and what lies between.
BETWEEN = r'[^"{}\[\]\n]*+'
QUIET = rf'{BETWEEN}(?:(?:"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"|\n(?![\[{{])|(?<=[,:\[{{])\n){BETWEEN})*+'
SKIP = re.compile(QUIET)
#: Objects with up to four brackets within one another, which leave the state as it was; deeper ones go bracket by bracket.
INNER = QUIET
for _ in range(4):
    INNER = rf"{QUIET}(?:[{{\[]{INNER}[}}\]]{QUIET})*+"
OBJECT = re.compile(rf"\{{{INNER}[}}\]]")
#: Bytes that are scanned at once, or one piece.
CHUNK = 1 << 20


class Scanner:
    """The state while a text passes by in pieces; ``pops`` counts closed brackets that were open before."""

    def __init__(self, in_string: bool = False, stack: str = "", known: bool = False):
        self.in_string, self.brackets, self.known, self.pops = in_string, list(stack), known, 0

    @property
    def stack(self) -> str:
        return "".join(self.brackets)

    @property
    def depth(self) -> int:
        return len(self.brackets)

    @property
    def outer(self) -> str:
        """The two outermost open brackets, which with their number are all that decides what is a record."""
        return "".join(self.brackets[:2])

    def feed(self, text: str) -> Iterator[tuple[str, int]]:
        """Moves over ``text``; yields ``("open", at)`` and ``("close", end)`` of records, and ``("reset", at)`` where what is open is cut short.

        Openings and closings are right only if the state before was known.  Text before is taken to end with a brace.
        """
        at = 0
        if self.in_string:
            m = STRING_END.match(text)
            at = m.end()
            if at == len(text) and not m[1]:
                return
            self.in_string = False
        brackets = self.brackets
        while (at := SKIP.match(text, at).end()) < len(text):
            c = text[at]
            if c == "{" and (not brackets or brackets == ["["]):
                yield "open", at
                if m := OBJECT.match(text, at):
                    at = m.end()
                    yield "close", at
                else:
                    brackets.append(c)
                    at += 1
            elif c in "{[":
                brackets.append(c)
                at += 1
            elif c == '"':
                m = TOKENS.match(text, at)
                at = m.end()
                if at == len(text) and not m[1]:
                    self.in_string = True
                    return
            elif c == "\n":
                k = at
                at += 1
                while k and text[k - 1].isspace():
                    k -= 1
                if not k or text[k - 1] not in ",:[{":
                    if brackets or not self.known:
                        yield "reset", at
                    brackets.clear()
                    self.known = True
            else:
                at += 1
                if brackets:
                    closes = len(brackets) < 3 and brackets in (["{"], ["[", "{"])
                    brackets.pop()
                    if closes:
                        yield "close", at
                elif not self.known:
                    self.pops += 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of files between closing braces, with the file and the byte range each piece is read in."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(meta["file_path"].alias(FILE), meta["file_block_start"].alias("_start"), meta["file_size"].alias("_size"), "value")


def _by_range(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Values of ``names``, whether the text is its range's first and last, its pieces with closing braces between them, and its bytes with one after each; the pieces of a range follow one another."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces, n_bytes = batch.column("value"), pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        edges = np.diff(np.cumsum(n_bytes) // CHUNK) > 0
        for key in names[:2]:
            column = batch.column(key)
            edges |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(edges) + 1).tolist(), batch.num_rows]
        for at, to in zip(edges, edges[1:]):
            key = [batch.column(n)[at].as_py() for n in names]
            new = held is None or key[:2] != held[0][:2]
            if held:
                yield held[0], held[1], new, *held[2:]
            held = key, new, "}".join(pieces.slice(at, to - at).to_pylist()), int(n_bytes[at:to].sum())
    if held:
        yield held[0], held[1], True, *held[2:]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("in_string", "known", "pops", "outer", "depth")
    names = [FILE, "_start", "_size", "n_bytes", "head", *[f"{f}{k}" for k in (0, 1) for f in fields]]
    for (file, start, size), first, last, text, length in _by_range(batches, [FILE, "_start", "_size"]):
        if first:
            runs = [Scanner(known=True)] if start == 0 else [Scanner(), Scanner(in_string=True)]
            n_bytes, head = 0, ""
        n_bytes += length
        head = head or text.lstrip("\ufeff \t\r\n}")[:1]
        for run in runs:
            for _ in run.feed(text + "}"):
                pass
        if last:
            values = [file, start, size, n_bytes, head, *[getattr(r, f) for r in (runs[0], runs[-1]) for f in fields]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)


def _states(group):
    """The state in which each byte range of a file begins, the range in which a record began that is open there, and about the file its first character and whether brackets stay open."""
    group = group.sort_values("_start")
    in_string, outer, depth, origin, out = False, "", 0, -1, []
    whole = group["n_bytes"].sum() == group["_size"].iloc[0]
    for r in group.to_dict("records"):
        out.append([r[FILE], r["_start"], in_string, outer, depth, origin, False])
        k, record = int(in_string), 0 if outer[:1] == "{" else 1 if outer == "[{" else None
        left = 0 if r[f"known{k}"] else max(0, depth - r[f"pops{k}"])
        outer, depth, in_string = (outer[:left] + r[f"outer{k}"])[:2], left + r[f"depth{k}"], r[f"in_string{k}"]
        if record is None or left <= record:  # else the record that was open still is
            origin = r["_start"] if outer[:1] == "{" or outer == "[{" else -1
    out[-1][-1] = not whole  # the last piece is then not followed by a brace
    return type(group)([[*o, group["head"].iloc[0], depth > 0] for o in out], columns=[FILE, "_start", "in_string", "outer", "depth", "origin", "cut", "head", "open"])


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a range and the parts of those that reach over its ends.

    ``state`` is good, damaged, part (of a record that goes on), end, or broken (its end before its time); ``_n`` is the number
    of good ones before it in the range, ``_origin`` the range in which it begins.
    """
    rows: list[tuple] = []
    size = 0

    def flushed():
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[FILE, "_start", "_n", "_origin", "state", "text"])
        rows.clear()
        return out

    for (file, start, in_string, outer, depth, origin, cut), first, last, text, _ in _by_range(batches, [FILE, "_start", "in_string", "outer", "depth", "origin", "cut"]):
        if first:
            if in_string is None:
                raise RuntimeError(f"the byte ranges of {file} changed while it was read")
            scan, n = Scanner(in_string, outer.ljust(depth, "{"), True), 0
            held, mine = ([], origin) if origin >= 0 else (None, start)
        text, begin = text if last and cut else text + "}", 0
        for what, at in scan.feed(text):
            if what == "open":
                held, mine, begin = [], start, at
            elif held is not None:
                record, held = "".join(held) + text[begin:at], None
                state = ("good" if what == "close" and _parses(record) else "damaged") if mine == start else "end" if what == "close" else "broken"
                rows.append((file, start, n, mine, state, record))
                n, size = n + (state == "good"), size + len(record)
                if size > 1 << 22 or len(rows) >= 10_000:
                    yield flushed()
                    size = 0
        if held is not None:
            held.append(text[begin:])
            if last:
                rows.append((file, start, n, mine, "part", "".join(held)))
    if rows:
        yield flushed()


def _is_json(text: str) -> Column:
    @F.pandas_udf("boolean")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(_parses)

    return parse(text)


def read_pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of the files of ``path`` as text, and one row for each file.

    Records have ``_file`` (its path), ``_place`` (from 0 in the file; null for damaged ones, which aren't counted), ``text`` and
    ``damaged``.  A record is damaged if a line that begins outside cuts it short, if the file ends before
    it does, or if it isn't JSON.  Files have ``_file``, ``head`` (the first character that isn't white space), ``open`` (brackets that
    stay open at its end), ``n_records`` and ``n_damaged``.  Values that are neither objects nor in an
    outermost array hold no records.  Files of no bytes aren't there.

    A record may be as long as a string can be, and is put together by one task; all else is spread by byte range, also for files
    without a line feed.  Compressed files have one range.
    """
    pieces = _pieces(spark, path)
    kinds = ", ".join(f"in_string{k} boolean, known{k} boolean, pops{k} long, outer{k} string, depth{k} long" for k in (0, 1))
    effects = pieces.mapInArrow(_summarise, f"{FILE} string, _start long, _size long, n_bytes long, head string, {kinds}")
    states = staged(effects.groupBy(FILE).applyInPandas(_states, f"{FILE} string, _start long, in_string boolean, outer string, depth long, origin long, cut boolean, head string, open boolean"), "record-states")
    small = states.count() <= BROADCAST_RANGES
    about = states.drop("head", "open")
    if small:
        known = pieces.join(F.broadcast(about), [FILE, "_start"], "left")
    else:
        known = pieces.withColumn("_at", F.monotonically_increasing_id()).join(about, [FILE, "_start"], "left").repartition(FILE, "_start").sortWithinPartitions(FILE, "_start", "_at")
    parts = staged(known.mapInArrow(_cut, f"{FILE} string, _start long, _n long, _origin long, state string, text string"), "record-parts")
    reaches = F.col("state").isin("part", "end", "broken")  # two rows at most for each byte range
    together = parts.where(reaches).groupBy(FILE, F.col("_origin").alias("_start")).agg(
        F.max(F.when(F.col("_start") == F.col("_origin"), F.col("_n"))).alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or(F.col("state") == "end").alias("ends"),
    )
    together = staged(together.select(FILE, "_start", "_n", "text", (F.col("ends") & _is_json("text")).alias("good")), "record-joined")
    found = parts.where(~reaches).select(FILE, "_start", "_n", "text", (F.col("state") == "good").alias("good")).unionByName(together)
    counts = found.groupBy(FILE, "_start").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    ranges = staged(states.select(FILE, "_start", "head", "open").join(counts, [FILE, "_start"], "left").fillna(0, ["n_good", "n_bad"]), "record-counts")
    files = ranges.groupBy(FILE).agg(F.first("head").alias("head"), F.first("open").alias("open"), F.sum("n_good").alias("n_records"), F.sum("n_bad").alias("n_damaged"))
    earlier = Window.partitionBy(FILE).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.select(FILE, "_start", F.coalesce(F.sum("n_good").over(earlier), F.lit(0)).alias("_ahead"))
    placed = found.join(F.broadcast(ahead) if small else ahead, [FILE, "_start"])
    return placed.select(FILE, F.when(F.col("good"), F.col("_ahead") + F.col("_n")).alias(PLACE), "text", (~F.col("good")).alias("damaged")), files
