"""Scalar functions on hand-written cases."""

import re

import pytest
from pyspark.sql import functions as F

from listingflow.functions import html, ids, numbers, security, templates, text, validation
from listingflow.functions.json_repair import balanced, partial, records_of, repair_json, repaired, split_records


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.normalize_string, "  A \t\n B　c ", "a b c"),
        (text.normalize_string, None, None),
        (text.clean_description, "A  b\n\nc é <x> {y}!", "A b c  x {y}!"),
        (text.clean_description, None, ""),
        (text.error_category, "Connection reset", "network"),
        (text.error_category, "Invalid JSON", "parsing"),
        (text.error_category, "invalid id", "validation"),
        (text.error_category, "rate exceeded", "api"),
        (text.error_category, "disk full", "file"),
        (text.error_category, "an operation", "file"),
        (text.error_category, "boom", "other"),
        (text.parse_error_kind, "Unexpected end of input", "truncation"),
        (text.estimate_tokens, "", 0),
        (text.estimate_tokens, "abcd", 1),
        (text.estimate_tokens, "abcde", 2),
        (text.file_name, "A b/c", "A_b_c"),
        (text.strip_fences, "```json\n{}\n```", "{}"),
        (text.strip_thoughts, "<thought>a\nb</thought>x\ny", "x y"),
        (ids.id_from_url, "https://h/jobs/view/some-title-12345", "12345"),
        (ids.id_from_url, "https://h/jobs/view/12345", "12345"),
        (ids.id_from_url, "https://h/jobs/c/view/77", "77"),
        (ids.id_from_url, "none", None),
        (ids.id_or_hash, "https://h/jobs/view/slug/55?position=1", "55"),
        (lambda u: ids.repair_url(u, "site.com"), "https://www.site.comhttps://site.comhttps://x.org/1", "https://x.org/1"),
        (security.mask, "abcdefgh", "********"),
        (security.mask, "abcdefghij", "abcd**ghij"),
        (security.mask_short, "abcdefghij", "abcd...ghij"),
        (lambda c: security.is_clean(c, "email"), "a.b@c.org", True),
        (lambda c: security.is_clean(c, "sql"), "x' OR 1=1 --", False),
        (security.is_clean, "", False),
        (security.is_real_key, "abcdefghijklmnop-1", True),
        (security.is_real_key, "my-demo-key-abcdefgh", False),
        (security.safe_path, "a/b.json", "a/b.json"),
        (security.safe_path, "a\\b.json", "a/b.json"),
        (security.safe_path, "../b", None),
        (security.safe_path, "/etc/passwd", None),
        (security.safe_path, "a/con", None),
        (security.safe_path, "a/x.exe", None),
        (security.is_safe_url, "javascript:alert(1)", False),
        (security.is_safe_url, "https://x.org/a", True),
        (security.strip_parameters, "https://x/p?token=1&a=2&Secret=3#f", "https://x/p?a=2#f"),
        (security.strip_parameters, "https://x/p?token=1", "https://x/p"),
        (security.redact, "api_key = 'abcdefghijk' ok", "[REDACTED] ok"),
        (security.has_sensitive, "token: x1", True),
        (security.longest_run, "aabbbbc", 4),
        (security.printable, "a<b>é&c", "abc"),
        (security.sanitize, " <script>x</script>hi ", "hi"),
        (lambda c: html.tag_text(c, "h1"), "<h1 class=a>A <b>b</b></h1>", "A b"),
        (templates.sections, "x\n# A\none\n# B\n2\n# A\nlast", {"A": "last", "B": "2"}),
        (templates.sections, None, {}),
    ],
)
def test_text_functions(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("ms, want", [(500, "0s 500ms"), (1500, "1s"), (65000, "1m 5s"), (3665000, "61m 5s"), (0, "0s"), (60000, "1m")])
def test_durations(spark, ms, want):
    assert one(spark, ms, numbers.format_duration, "long") == want


@pytest.mark.parametrize("value, want", [("$80,000 - $120,000", (100000, 100000)), ("80,000 - 120,000", (80000, 120000)), ("$95,000", (95000, 95000)), ("none", None)])
def test_text_salary(spark, value, want):
    got = one(spark, value, numbers.text_salary)
    assert (got and (got["min"], got["max"])) == want


@pytest.mark.parametrize("value, want", [("$65,000.00 - $90,000.00", (65000.0, 90000.0, "USD")), ("€5", (5.0, -1.0, "EUR")), ("x", (-1.0, -1.0, ""))])
def test_card_salary(spark, value, want):
    assert tuple(one(spark, value, numbers.card_salary)) == want


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.half_up(F.lit(1.005), 2).alias("a"), numbers.backoff(F.lit(10)).alias("b"), numbers.error_status(F.lit("TIMEOUT_ERROR")).alias("c"), numbers.error_status(F.lit("?")).alias("d"),
        numbers.format_bytes(F.lit(1536)).alias("e"), numbers.preferred(F.lit(None).cast("int"), F.lit(0), F.lit(5)).alias("f"),
        numbers.format_date(F.timestamp_seconds(F.lit(0)), "stamp").alias("g"), numbers.is_retryable(F.lit(408)).alias("h"),
        numbers.compensation(F.lit(""), F.lit(10.0), F.lit(20.0), F.lit("EUR"), F.lit(True)).alias("i"),
    ).first()
    assert tuple(row) == (1.0, 30000.0, 504, 500, "1.50 KB", 0, "19700101_000000", True, "EUR 10 - 20 (Remote OK)")


def test_truncation_by_sentence_word_and_cut(spark):
    for value, want in (("short", "short"), ("a" * 37 + ". " + "b" * 30, "a" * 37 + "."), ("a b" * 3 + "x" * 26 + ". " + "c" * 30, "a b" * 3 + "x" * 26 + "."), ("s. " * 8 + "x" * 13 + " " + "c" * 30, "s. " * 8 + "x" * 13), ("z" * 99, "z" * 40)):
        assert one(spark, value, lambda c: text.truncate_to_tokens(c, 10)) == want


@pytest.mark.parametrize(
    "value, json_text, way",
    [
        ('{"a":1}', '{"a":1}', "direct"),
        ('```json\n[1]\n```', "[1]", "cleaned"),
        ('{"a":[1,2,],}', '{"a":[1,2]}', "trailing_comma"),
        ('[{"a":1', '[{"a":1}]', "balanced"),
        ('say [{"a":1},{"b":', "[]", None),
        ('x {"a":{"b":1}} y {"c":2} z {bad}', '[{"a":{"b":1}},{"c":2}]', "partial"),
        ("nothing", "[]", "partial"),
        (None, None, "missing"),
    ],
)
def test_json_repair(value, json_text, way):
    got = repaired(value)
    if way:
        assert got == (json_text, way)
    else:
        assert got[1] == "partial"


def test_json_parts(spark):
    assert balanced('{"a":"}') == '{"a":"}}' and partial('{"a":1} {"bb":22}', longest=True) == '{"bb":22}'
    assert split_records('[{"a":1},2]{"b":\n3}\n{bad\n{"c":4}') == ['{"a": 1}', '{"b": 3}', '{"c": 4}']
    assert one(spark, '{"a":1,}', lambda c: repair_json(c)["json"]) == '{"a":1}' and one(spark, '{"a":1}\n{"a":2}', records_of) == ['{"a": 1}', '{"a": 2}']


def test_templates_are_literal(spark):
    row = spark.createDataFrame([("$1 {b}",)], "x string").select(templates.render("<{a}|{b}>", {"a": F.col("x"), "b": F.lit(3)}).alias("s"), templates.render("{{a}}", {"a": F.col("x")}, True).alias("d")).first()
    assert row["d"] == "$1 b" and row["s"].startswith("<$1 ")
    assert templates.missing_values("{a} {b}", {"a"}) == {"b"}


def test_key_strength_and_audit(spark):
    got = one(spark, "aaaa1111bbbb2222", lambda c: security.key_strength(c))
    assert got["valid"] and "letters and digits only" in got["warnings"] and "low entropy" in got["warnings"]
    assert not one(spark, "sk-test_abcdefghijklmnop", lambda c: security.key_strength(c))["valid"]
    assert one(spark, "x", lambda c: security.audit({"a": F.lit(True)}, F.array(), F.array()))["is_secure"]
    assert one(spark, {"API_Token": "x", "q": "y"}, lambda c: security.redact_map(c, ("token",)), "map<string,string>") == {"API_Token": "[REDACTED]", "q": "y"}


def test_rules(spark):
    rows = [("1", "T", "C", "D", "https://a.b", "2024-01-02"), ("bad id!", "", None, "x", "nope", "never")]
    df = spark.createDataFrame(rows, "id string, title string, company string, descriptionText string, url string, postedDate string")
    got = df.select(validation.errors(validation.required_rules()).alias("a"), validation.errors(validation.listing_rules(df.columns)).alias("b")).collect()
    assert got[0]["a"] == got[0]["b"] == []
    assert got[1]["a"] == ["title is required", "company is required", "Invalid URL format", "Invalid date format"]
    assert "id contains invalid characters" in got[1]["b"] and "postedDate contains invalid characters" in got[1]["b"]
    call = spark.createDataFrame([(3.0, 0.0, 10, 5)], "temperature double, topP double, maxTokens int, timeout int")
    assert call.select(validation.errors(validation.call_rules()).alias("e")).first()["e"] == ["temperature is out of range", "topP is out of range"]


def test_registry_ids(spark):
    df = spark.createDataFrame([("a b!1", None, "t"), (None, "https://www.site.com/view/slug/99", "t"), (None, "https://other.org/view/slug/9", "t"), (None, None, "t")], "i string, u string, t string")
    got = [r[0] for r in df.select(ids.registry_id(F.col("i"), F.col("u"), F.col("t"), "site.com")).collect()]
    assert got[:3] == ["ab1", "99", None] and len(got[3]) == 12
    assert [r[0] for r in df.select(ids.record_id(F.col("i"), F.col("u"), F.col("t"))).collect()][0] == "a b!1"


def test_white_space_of_every_kind_is_one_space(spark):
    odd = [chr(i) for i in range(0x3100) if chr(i).isprintable() or chr(i).isspace() or i < 0x100] + ["\ufeff", "\ufffd", "\U0001f600"]
    rows = [f"{a}x {b}{a}  Y\t{a} z{b}" for a in odd for b in ("", " ", "\u2003", "\ufeff", "\u00e9")] + [None, "", " ", "\u3000"]
    plain = lambda t: re.sub(f"[{text.SPACE}]+", " ", t)
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.clean_description(F.col("t")).alias("c"), text.normalize_string(F.col("t")).alias("n"), F.lower("t").alias("l"))
    for t, c, n, lower in df.collect():
        assert c == re.sub(r"""[^A-Za-z0-9_ \-.,;:!?()"'\[\]{}]""", "", plain(t or "")).strip(" "), ascii(t)
        assert n == (None if t is None else plain(lower).strip(" ")), ascii(t)


def test_single_spaces_and_plain_letters_are_no_matches(spark, monkeypatch):
    found = []
    whole = F.regexp_replace
    monkeypatch.setattr(text.F, "regexp_replace", lambda c, pattern, by: (found.append(pattern), whole(c, pattern, by))[1])
    text.clean_description(F.lit("x"))
    text.normalize_string(F.lit("x"))
    counts = [F.regexp_count(F.lit("Some plain words, (as) in most texts."), F.lit(p)).alias(f"n{i}") for i, p in enumerate(found)]
    assert set(spark.range(1).select(*counts).first()) == {0}
