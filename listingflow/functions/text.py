"""Text columns with the semantics of loosely typed records: empty strings count as missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the records' origin, wider than ASCII.
SPACE = "\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Classes of single Latin-1 characters are one table lookup, ranges and others a chain of comparisons.  Those that aren't white space:
_PLAIN = "".join(rf"\x{i:02x}" for i in [*range(0x21, 0x7F), *range(0xA1, 0x100)])
_KEPT = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])) + r"""_ \-.,;:!?()"'\[\]{}"""

#: Needles of error categories, in order of precedence.
ERROR_NEEDLES = (
    ("network", ("network", "connection", "timeout")),
    ("parsing", ("parsing", "json", "format")),
    ("validation", ("validation", "invalid")),
    ("api", ("api", "rate", "limit")),
    ("file", ("file", "disk", "io")),
)
#: Needles of parse failures, in order of precedence.
PARSE_NEEDLES = (
    ("truncation", ("truncated", "unexpected end")),
    ("syntax", ("unexpected token", "invalid syntax")),
    ("structure", ("property", "object")),
)
#: Needles of network failures.
NETWORK_NEEDLES = ("network", "timeout", "connection", "fetch", "request", "errno", "econnreset", "econnrefused", "enotfound")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def one_space(c: Column) -> Column:
    """Runs of white space as one space; one that is so already is no match, as each would be copied."""
    return F.regexp_replace(c, f"(?![{_PLAIN}])(?: [{SPACE}]+|[{SPACE.replace(' ', '')}][{SPACE}]*)", " ")


def normalize_string(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.trim(one_space(F.lower(c)))


def pair_key(title: Column, company: Column) -> Column:
    """Lower-cased title and company, not trimmed; null if either is."""
    return F.concat(F.lower(title), F.lit("::"), F.lower(company))


def fuzzy_key(*columns: Column) -> Column:
    return F.concat_ws("_", *[F.regexp_replace(F.lower(c), f"[{SPACE}]+", "_") for c in columns])


def clean_description(c: Column) -> Column:
    """One space for white space; only ASCII words and basic punctuation stay."""
    spaced = one_space(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(spaced, f"[^{_KEPT}]+", ""))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | c.contains(n)
    return found


def cascade(c: Column, needles, other: str) -> Column:
    """The first category one of whose needles the lower-cased text contains."""
    low, out = F.lower(c), None
    for name, words in needles:
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def error_category(message: Column) -> Column:
    return cascade(message, ERROR_NEEDLES, "other")


def parse_error_kind(message: Column) -> Column:
    return cascade(message, PARSE_NEEDLES, "unknown")


def is_network_error(message: Column) -> Column:
    return contains_any(F.lower(message), NETWORK_NEEDLES)


def remote_flag(title: Column) -> Column:
    return title.rlike("(?i)remote|no office location")


def stack_tags(title: Column, url: Column, stacks: list[str]) -> Column:
    """Parts of title and URL, split at spaces and hyphens, that are known stacks, in order of first occurrence."""
    words = F.concat(F.split(F.lower(F.coalesce(title, F.lit(""))), "[ -]"), F.split(F.lower(F.coalesce(url, F.lit(""))), "[ -]"))
    return F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, stacks)).cast("array<string>"))


def estimate_tokens(c: Column) -> Column:
    """One token for every four characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def truncate_to_tokens(c: Column, tokens: int) -> Column:
    """At most four characters a token, cut after a sentence, else after a word, where that keeps over 80 per cent."""
    most = 4 * tokens
    head = F.substring(c, 1, most)
    sentence = F.greatest(*[F.length(head) - F.locate(m, F.reverse(head)) + F.when(F.locate(m, F.reverse(head)) > 0, 1).otherwise(-F.length(head)) for m in ".!?"])
    by_sentence = F.when(sentence - 1 > most * 0.5, F.substring(head, F.lit(1), sentence)).otherwise(head)
    space = F.locate(" ", F.reverse(head))
    at = F.length(head) - space
    by_word = F.when((space > 0) & (at > most * 0.8), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= most, c).when(F.length(by_sentence) > most * 0.8, by_sentence).otherwise(by_word)


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def strip_fences(c: Column) -> Column:
    """A model's answer without code fences and lead-ins."""
    for pattern in (r"(?i)^```json\s*", r"^```\s*", r"\s*```\s*$", r"(?i)^here's the json:\s*", r"(?i)^json:\s*", r"(?i)\s*json\s*$"):
        c = F.regexp_replace(c, pattern, "")
    return trimmed(c)


def answer_results(c: Column, schema: str) -> Column:
    """The ``results`` of a model's answer as an array of ``schema``, thoughts cut out; empty where it isn't such an answer."""
    found = F.from_json(strip_thoughts(c), f"results array<{schema}>")["results"]
    return F.coalesce(found, F.from_json(F.lit("[]"), f"array<{schema}>"))


def strip_thoughts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<thought>.*?</thought>", ""), r"\n", " ")
