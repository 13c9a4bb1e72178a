"""Parsing of damaged JSON, and of records written one after another."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAD = (r"^```json\s*", r"^```\s*", r"\s*```\s*$", r"^here's the json:\s*", r"^json:\s*", r"\s*json\s*$")


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def cleaned(text: str) -> str:
    for pattern in LEAD:
        text = re.sub(pattern, "", text, flags=re.I)
    return text.strip()


def balanced(text: str) -> str:
    """``text`` with the braces, then the brackets that it leaves open closed at its end."""
    outside = re.sub(r'"(?:\\.|[^"\\])*(?:"|\Z)', "", text, flags=re.S)
    still = {}
    for up, down in ("{}", "[]"):
        depth = 0
        for c in outside:
            depth = depth + 1 if c == up else max(0, depth - 1) if c == down else depth
        still[down] = depth
    return text + "}" * still["}"] + "]" * still["]"]


def partial(text: str, longest: bool = False) -> str:
    """What can be saved: the first array, else all objects, nested once at most; or the longest flat object."""
    if longest:
        flat = re.findall(r"\{[^{}]*\}", text)
        best = max(flat, key=len, default="")
        return best if best and _parses(best) else "{}"
    first = re.search(r"\[.*?\]", text, re.S)
    if first and _parses(first[0]):
        return first[0]
    return "[" + ",".join(x for x in re.findall(r"\{(?:[^{}]|\{[^{}]*\})*\}", text) if _parses(x)) + "]"


def repaired(text: str | None) -> tuple[str | None, str]:
    """JSON and the way it was come by; each repair is tried alone on the cleaned text."""
    if text is None:
        return None, "missing"
    if _parses(text):
        return text, "direct"
    clean = cleaned(text)
    for way, repair in (
        ("cleaned", lambda x: x),
        ("trailing_comma", lambda x: re.sub(r",(\s*[}\]])", r"\1", x)),
        ("escapes", lambda x: re.sub(r'\\([nrtbf"\\])', r"\1", x)),
        ("balanced", balanced),
    ):
        if _parses(got := repair(clean)):
            return got, way
    return partial(clean), "partial"


def is_json(text: Column) -> Column:
    """Whether a text surely is one JSON value, told without Python; the parser stops after a value, so the text must be one within a list and within an object."""
    fits = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return F.coalesce(fits("[", "]") & fits('{"k":', "}"), F.lit(False))


def repair_json(text: Column) -> Column:
    """A struct of ``json`` and of the ``way`` it was come by; texts that are JSON already don't go through Python."""

    @F.pandas_udf("struct<json:string,way:string>")
    def repair(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired(t) for t in texts], columns=["json", "way"])

    direct = is_json(text)
    found = repair(F.when(~direct, text))
    return F.struct(F.when(direct, text).otherwise(found["json"]).alias("json"), F.when(direct, "direct").otherwise(found["way"]).alias("way"))


def split_records(text: str | None) -> list[str]:
    """Records of an array, one object, or objects one after another; damaged ones end at the next that starts a line."""
    decoder, found, at = json.JSONDecoder(), [], 0
    text = (text or "").lstrip("\ufeff")
    while at < len(text):
        start = re.compile(r"[\[{]").search(text, at)
        if not start:
            break
        try:
            value, at = decoder.raw_decode(text, start.start())
        except ValueError:
            again = re.compile(r"^[\[{]", re.M).search(text, start.end())
            if not again:
                break
            at = again.start()
            continue
        found += [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return found


def records_of(text: Column | str) -> Column:
    """The records of a file's text, each as JSON."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_records)

    return split(text)


