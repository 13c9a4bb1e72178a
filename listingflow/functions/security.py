"""Screens, guards and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern families of hostile input.
XSS = (
    r"(?i)<script[^>]*?>.*?</script>", r"(?i)javascript:", r"(?i)on\w+\s*=", r"(?i)<iframe[^>]*>", r"(?i)<object[^>]*>", r"(?i)<embed[^>]*>", r"(?i)<form[^>]*>",
    r"(?i)<input[^>]*>", r"""(?i)<link[^>]*rel\s*=\s*['"]?['"]?\s*stylesheet[^>]*>""", r"(?i)<style[^>]*>.*?</style>", r"(?i)expression\s*\(", r"(?i)javascript\s*:",
    r"(?i)vbscript\s*:", r"(?i)data\s*:\s*text/html", r"""(?i)<meta\s+http-equiv\s*=\s*['"]?refresh['"]?[^>]*>""",
)
SQL = (
    r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|EXEC|DECLARE|ALTER|CREATE|TRUNCATE|GRANT|REVOKE)\b\s*",
    r"(?i)''|''-|';|--|/\*|\*/|@@|xp_|sp_|exec\s*\(",
    r"""(?i)\b(OR|AND)\s+\w+\s*=\s*['"]?\w+['"]?""",
    r"(?i)\b(UNION\s+ALL\s+SELECT|UNION\s+SELECT)\b",
    r"""(?i)\b(WAITFOR\s+DELAY|SLEEP)\s*\(\s*['"]\d+['"]\s*\)""",
)
COMMAND = (
    r"[;&|`$(){}\[\]<>]",
    r"(?i)\b(exec|system|shell|cmd|bash)\b\s*\(",
    r"""(?i)\b(rm|del|deltree|rmdir)\b\s+-?r?f?\s*['"]?\w+['"]?""",
    r"(?i)\b(cd|pwd|ls|dir)\b\s+-?\w*",
)
TRAVERSAL = (r"\.\./\.\./", r"\.\.\\", r"/\.\./", r"\\..\\")
LDAP = (r"""(\(|\)|&|\||!|\*|\?|=|>|<|,|"|;|#)""",)
SSRF = (r"(?i)localhost|127\.0\.0\.1|0\.0\.0\.0|::1",)
SHAPES = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^(https?://)?([\da-z.-]+)\.([a-z.]{2,6})([/\w .-]*)$",
    "apiKey": r"^[a-zA-Z0-9\-_]{16,128}$",
    "file": r"^[a-zA-Z0-9_\-./\\]+$",
}
#: Words and prefixes of keys that are not real.
TEST_WORDS = ("test", "demo", "sample", "example", "mock", "fake")
TEST_PREFIXES = ("sk-test_", "test_", "demo_", "dummy_", "example_", "sample_")
#: Names of sensitive content, parameters, devices and file types.
SENSITIVE = (r"password", r"api[_-]?key", r"secret", r"token", r"private[_-]?key", r"certificate", r"ssh[_-]?key")
SENSITIVE_PARAMETERS = ("api_key", "token", "secret", "password", "auth")
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8")
RUNNABLE = (".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar")
PROTOCOLS = ("javascript", "data", "vbscript", "file")
#: What is cut from file contents.
REDACTED = (
    r"""(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*["']?[a-zA-Z0-9_-]{10,}["']?""",
    r"(?i)(?:sk-|pk-)[a-zA-Z0-9_-]{20,}",
    r"(?i)Bearer\s+[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
)
GENERAL = XSS + SQL + COMMAND
FAMILIES = {
    "general": (SQL[:1], XSS[:3], COMMAND[:1]), "file": (TRAVERSAL, COMMAND[:1]), "url": (XSS[:3], SSRF, COMMAND[:1]),
    "command": (COMMAND[:1], SQL[:1]), "database": (SQL[:1], LDAP), "api": (SQL[:1], XSS[:3], SSRF),
}


def matches_any(c: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def removed(c: Column, patterns, by: str = "") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c


def is_clean(c: Column, kind: str = "general") -> Column:
    """Whether input of a kind passes; missing and empty input doesn't."""
    ok = {
        "xss": ~matches_any(c, XSS), "sql": ~matches_any(c, SQL), "command": ~matches_any(c, COMMAND),
        "path": ~matches_any(c, TRAVERSAL) & c.rlike(SHAPES["file"]), "email": c.rlike(SHAPES["email"]), "url": c.rlike(SHAPES["url"]), "apiKey": c.rlike(SHAPES["apiKey"]),
    }.get(kind, ~matches_any(c, GENERAL))
    return F.coalesce((F.length(c) > 0) & ok, F.lit(False))


def passes_rules(c: Column, kind: str = "general", least: int = 0, most: int | None = None, digits: bool | None = None, letters: bool | None = None, spaces: bool | None = None, strict: bool = False) -> Column:
    """Length, character classes (True asks for them, False forbids them) and the kind's pattern families."""
    ok = (F.length(c) > 0) & (F.length(c) >= least)
    if most is not None:
        ok = ok & (F.length(c) <= most)
    for wanted, pattern in ((digits, r"\d"), (letters, "[a-zA-Z]"), (spaces, r"\s")):
        if wanted is not None:
            ok = ok & (c.rlike(pattern) == F.lit(wanted))
    for family in FAMILIES.get(kind, FAMILIES["general"]):
        ok = ok & ~matches_any(c, family)
    if strict:
        control = F.length(F.regexp_replace(c, r"[^\x00-\x1f\x7f]", ""))
        ok = ok & ~c.contains("\0") & (control <= F.length(c) * 0.1)
    return F.coalesce(ok, F.lit(False))


def sanitize(c: Column, strip_tags: bool = False, most: int | None = None) -> Column:
    c = F.coalesce(c, F.lit(""))
    if strip_tags:
        c = F.regexp_replace(c, "<[^>]*>", "")
    c = F.trim(removed(c, (*XSS, *SQL, *COMMAND, *TRAVERSAL)))
    return F.substring(c, 1, most) if most else c


def printable(c: Column) -> Column:
    """Printable ASCII without the characters that markup needs."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20-\x7E]", ""), """[<>"'&]""", "")


def safe_path(c: Column, extensions: tuple = (), bases: tuple = ()) -> Column:
    """The path with forward slashes, or null if it leaves its folder, is absolute, reserved or runnable."""
    path = F.translate(c, "\\", "/")
    name = F.substring_index(path, "/", -1)
    ok = ~path.rlike(r"^/|~(?:/|$)|\$\{.*\}|%.*%") & ~path.contains("..") & ~path.contains("\0") & F.length(name).between(1, 255)
    ok = ok & ~F.upper(name).isin(*RESERVED)
    for e in RUNNABLE:
        ok = ok & ~F.lower(name).endswith(e)
    if bases:
        within = F.lit(False)
        for b in bases:
            within = within | path.startswith(b)
        ok = ok & within
    if extensions:
        ok = ok & F.lower(F.substring_index(path, ".", -1)).isin(list(extensions))
    return F.when(ok, path)


def is_real_key(c: Column) -> Column:
    return F.coalesce(c.rlike(SHAPES["apiKey"]) & ~c.rlike("(?i)" + "|".join(TEST_WORDS)), F.lit(False))


def hash_key(c: Column) -> Column:
    """SHA-256 of a key in hexadecimal."""
    return F.sha2(c, 256)


#: What keys in files look like, and folders that aren't searched.
KEYS_IN_FILES = (r"""(?i)(?:api[_-]?key|secret|token)\s*[:=]\s*["']?[a-zA-Z0-9_-]{10,}["']?""", r"(?i)(?:sk-|pk-)[a-zA-Z0-9_-]{20,}")
SKIPPED_FOLDERS = ("node_modules", ".git", ".next", "dist", "build")


def keys_in(text: Column, most: int = 3) -> Column:
    """For each pattern of :data:`KEYS_IN_FILES` its first ``most`` matches, joined."""
    return F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, most) for p in KEYS_IN_FILES])


def key_strength(c: Column, provider: Column | None = None, trusted: tuple = (), least_entropy: float = 3.5, most_repeats: int = 3) -> Column:
    """Struct of ``valid`` and ``warnings`` for a key."""
    valid = F.length(c).between(16, 128) & ~c.rlike("(?i)^(" + "|".join(TEST_PREFIXES) + ")")
    if provider is not None and trusted:
        valid = valid & provider.isin(list(trusted))
    notes = F.array(
        F.when(c.rlike("^[a-zA-Z0-9]{10,}$"), "letters and digits only"),
        F.when(c.rlike("^[0-9]+$"), "digits only"),
        F.when(entropy(c) < least_entropy, "low entropy"),
        F.when(longest_run(c) > most_repeats, "repeated characters"),
    )
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.filter(notes, lambda x: x.isNotNull()).alias("warnings"))


def mask(c: Column) -> Column:
    """Stars but for the first and last four characters; all stars up to eight characters."""
    n = F.length(c)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(c, -4, 4)))


def mask_short(c: Column) -> Column:
    return F.when(F.length(c) <= 8, "[REDACTED]").otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4)))


def is_safe_url(c: Column) -> Column:
    ok = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.+") & ~F.lower(c).rlike("^(" + "|".join(PROTOCOLS) + "):") & ~F.lower(c).rlike(r"\?.*(<script|javascript:|vbscript:)")
    return F.coalesce(ok, F.lit(False))


def strip_parameters(c: Column) -> Column:
    """The URL without parameters that carry secrets."""
    names = "|".join(SENSITIVE_PARAMETERS)
    cut = F.regexp_replace(c, rf"(?i)([?&])(?:(?:{names})=[^&#]*(?:&|(?=#|$)))+", "$1")
    return F.regexp_replace(cut, r"[?&](?=#|$)", "")


def has_sensitive(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)(" + "|".join(SENSITIVE) + r""")\s*[:=]\s*['"]?\w+['"]?"""), F.lit(False))


def redact(c: Column, more: tuple = ()) -> Column:
    return removed(c, (*REDACTED, *more), "[REDACTED]")


def redact_map(m: Column, needles: tuple, by: str = "[REDACTED]") -> Column:
    """Values whose lower-cased key contains a needle replaced."""
    hit = lambda k: F.exists(F.array(*map(F.lit, needles)), lambda n: F.lower(k).contains(n))
    return F.transform_values(m, lambda k, v: F.when(hit(k), F.lit(by)).otherwise(v))


def entropy(c: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    chars = F.split(c, "")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.length(c)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x)))


def longest_run(c: Column) -> Column:
    """The longest run of one character."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"((.)\2*)"), 1), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(1))


def audit(checks: dict[str, Column], warnings: Column, errors: Column) -> Column:
    """Struct of all checks and ``is_secure``: all hold, no error, fewer than three warnings."""
    ok = F.lit(True)
    for c in checks.values():
        ok = ok & c
    return F.struct(*[c.alias(n) for n, c in checks.items()], (ok & (F.size(errors) == 0) & (F.size(warnings) < 3)).alias("is_secure"))
