"""Prompt templates and sections of Markdown answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.text import trimmed


def render(template: str, values: dict[str, Column], double: bool = False) -> Column:
    """``{name}`` (or ``{{name}}``) replaced by values as they are; with double braces, values lose their own."""
    out = F.lit(template)
    for name, value in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        mark = "{{" + name + "}}" if double else "{" + name + "}"
        out = F.replace(out, F.lit(mark), F.translate(text, "{}", "") if double else text)
    return out


def missing_values(template: str, names: set[str], double: bool = False) -> set[str]:
    """Names that a template asks for and ``names`` doesn't hold."""
    return set(re.findall(r"\{\{(\w+)\}\}" if double else r"\{(\w+)\}", template)) - names


def sections(text: Column) -> Column:
    """A map from each ``# header`` to what follows it; text before the first is left out, the last of equal headers counts."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n# "), 2, 1 << 30)
    pair = lambda p: F.struct(trimmed(F.substring_index(p, "\n", 1)).alias("k"), trimmed(F.when(p.contains("\n"), F.substring(p, F.locate("\n", p) + 1, F.length(p))).otherwise("")).alias("v"))
    entries = F.transform(parts, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)
