"""Rules as columns, and the errors of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Column]

#: The choices of closed fields.
CHOICES = {
    "salaryCurrency": ["USD", "EUR", "GBP", "RON", "CHF", ""],
    "jobType": ["full-time", "part-time", "contract", "internship", "temporary", "freelance", "other"],
    "experienceLevel": ["internship", "entry", "associate", "mid-senior level", "director", "executive", "not applicable"],
    "employmentType": ["full-time", "part-time", "contract", "internship", "temporary", "other"],
    "seniorityLevel": ["intern", "entry", "associate", "mid-level", "senior", "lead", "manager", "director", "executive", "owner", "partner", "volunteer", "other"],
}
#: Field, least and greatest length, pattern, whether it must be there.
TEXTS = (
    ("id", 1, 50, r"^[a-zA-Z0-9\-_]+$", True),
    ("company", 1, 100, r"^[a-zA-Z0-9\s\-_&.,]+$", True),
    ("location", 1, 200, r"^[a-zA-Z0-9\s\-_.,]+$", True),
    ("title", 1, 200, r"^[a-zA-Z0-9\s\-_&.,()]+$", True),
    ("salary", 0, 50, r"^[0-9\s\-kK$€£¥]+$", False),
    ("jobFunction", 0, 100, r"^[a-zA-Z0-9\s\-_&.,()]+$", False),
    ("industries", 0, 200, r"^[a-zA-Z0-9\s\-_&.,()]+$", False),
    ("postedDate", 1, 50, r"^\d{4}-\d{2}-\d{2}$", False),
    ("applicants", 0, 20, r"^[0-9kKmM]+$", False),
    ("salaryRange", 0, 100, r"^[0-9\s\-kK$€£¥]+$", False),
    ("postedTime", 0, 50, r"^[0-9\s\-:+a-zA-Z]+$", False),
)
REQUIRED = ("title", "company", "descriptionText", "url")
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"


def text_rule(field: str, least: int, most: int, pattern: str, required: bool) -> list[Rule]:
    c = F.col(field)
    rules = [(f"{field} is too long", c.isNull() | (F.length(c) <= most)), (f"{field} contains invalid characters", c.isNull() | c.rlike(pattern))]
    if required:
        rules.insert(0, (f"{field} cannot be empty", c.isNotNull() & (F.length(c) >= least)))
    return rules


def choice_rule(field: str) -> Rule:
    return f"{field} is not a known value", F.col(field).isNull() | F.col(field).isin(CHOICES[field])


def range_rule(field: str, low: float | None, high: float | None, open_low: bool = False) -> Rule:
    c, ok = F.col(field), F.lit(True)
    if low is not None:
        ok = ok & ((c > low) if open_low else (c >= low))
    if high is not None:
        ok = ok & (c <= high)
    return f"{field} is out of range", c.isNull() | ok


#: Bounds of a model call's parameters, and whether the lower one is left out.
CALL_BOUNDS = {"temperature": (0, 2, False), "topP": (0, 1, True), "maxTokens": (0, 32000, True), "timeout": (0, 300000, True)}
#: What a provider must have.
PROVIDER_FIELDS = ("name", "baseUrl", "apiKey", "model")


def call_rules() -> list[Rule]:
    return [range_rule(f, *bounds) for f, bounds in CALL_BOUNDS.items()]


def provider_rules() -> list[Rule]:
    """A provider's configuration: four filled fields, a URL with a scheme, and the bounds of calls."""
    filled = [(f"{f} is required", F.coalesce(F.length(F.trim(F.col(f))) > 0, F.lit(False))) for f in PROVIDER_FIELDS]
    return [*filled, ("baseUrl is not a URL", F.coalesce(F.col("baseUrl").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.lit(False))), *call_rules()]


def listing_rules(columns: list[str]) -> list[Rule]:
    """Rules of a listing for those of its fields that are there."""
    rules: list[Rule] = []
    for spec in TEXTS:
        if spec[0] in columns:
            rules += text_rule(*spec)
    rules += [choice_rule(f) for f in CHOICES if f in columns]
    return rules


def required_rules() -> list[Rule]:
    """The short check: four fields filled, a URL that parses, a date that parses."""
    filled = [(f"{f} is required", F.coalesce(F.length(F.trim(F.col(f))) > 0, F.lit(False))) for f in REQUIRED]
    url = F.col("url")
    date = F.col("postedDate")
    return [*filled, ("Invalid URL format", (F.coalesce(url, F.lit("")) == "") | url.rlike(URL)), ("Invalid date format", (F.coalesce(date, F.lit("")) == "") | F.try_to_timestamp(date).isNotNull())]


def errors(rules: list[Rule]) -> Column:
    """The messages of the rules that don't hold; a rule that is null doesn't."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), message) for message, ok in rules]), lambda x: x.isNotNull())
