"""Column functions on single payloads: token estimates, redaction, format detection, store and ledger scalars.

All are Catalyst expressions; a payload is a string column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets, in the order in which they are replaced, and their replacements.
JWT = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
API_KEY = r"sk-[A-Za-z0-9]{20,}"
AWS_KEY = r"AKIA[0-9A-Z]{16}"
BASIC_AUTH = r"(https?://)[^:/\s@]+:[^@/\s]+@"
BEARER = r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*"
SECRETS = (
    (JWT, "[REDACTED:jwt]"),
    (API_KEY, "[REDACTED:api_key]"),
    (AWS_KEY, "[REDACTED:aws_key]"),
    (BASIC_AUTH, "$1[REDACTED-BASIC-AUTH]@"),
    (BEARER, "Bearer [REDACTED:bearer_token]"),
)
#: The name in markers that the filters and the store write.
MARKER = "parsimony"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(col(c)) / F.lit(4)).cast("long")


def redact(c: Column | str) -> Column:
    out = col(c)
    for pattern, put in SECRETS:
        out = F.regexp_replace(out, pattern, put)
    return out


def redaction_count(c: Column | str) -> Column:
    """Matches replaced, each counted in the text that its stage gets."""
    out, n = col(c), F.lit(0).cast("long")
    for pattern, put in SECRETS:
        n = n + F.regexp_count(out, F.lit(pattern)).cast("long")
        out = F.regexp_replace(out, pattern, put)
    return n


def contains_secret(c: Column | str) -> Column:
    c, found = col(c), F.lit(False)
    for pattern, _ in SECRETS:
        found = found | c.rlike(pattern)
    return found


def lines(c: Column | str) -> Column:
    """Lines without their ends: split at newlines, one carriage return in front of a newline taken off, no empty tail."""
    # a space behind the text keeps its last line apart from those that a newline ends
    parts = F.split(F.concat(col(c), F.lit(" ")), "\r?\n", -1)
    last = F.element_at(parts, -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(last == " ", whole).otherwise(F.concat(whole, F.array(F.substring(last, F.lit(1), F.length(last) - 1))))


def _json_kind(c: Column) -> Column:
    """OBJECT, ARRAY, another kind, or null if it isn't JSON. Parsing to a variant refuses repeated keys, which JSON allows; these payloads are read as a field of their own."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    field = F.concat(F.lit('{"x":'), c, F.lit("}"))
    read = lambda kind: F.from_json(field, f"x {kind}", strict)["x"].isNotNull()
    repeated = F.when(read("map<string,string>"), "OBJECT").when(read("array<string>"), "ARRAY")
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)), repeated)


def _has_messages(c: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(c), "$.messages[0]", "variant").isNotNull() | F.get_json_object(c, "$.messages[0]").isNotNull()


def is_json(c: Column | str) -> Column:
    return _json_kind(col(c)).isNotNull()


def detect_format(c: Column | str, from_wrap: bool = False) -> Column:
    c = col(c)
    kind, messages = _json_kind(c), _has_messages(c)
    system = F.get_json_object(c, "$.system").isNotNull() | F.array_contains(F.json_object_keys(c), "system")
    first = F.substring_index(c, "\n", 1)
    diff = first.startswith("diff --git") | first.startswith("@@") | c.contains("\n+++ ")
    plain = F.when(diff, "git_diff").otherwise("command_output" if from_wrap else "plain_text")
    is_object = kind.startswith("OBJECT")
    return F.when(is_object & messages, F.when(F.coalesce(system, F.lit(False)), "anthropic_json").otherwise("openai_json")).when(is_object | kind.startswith("ARRAY"), "json").otherwise(plain)


def detect_format_proxy(c: Column | str) -> Column:
    """Of a proxied body: messages make it openai_json, anything else is plain text."""
    c = col(c)
    return F.when(_json_kind(c).startswith("OBJECT") & _has_messages(c), "openai_json").otherwise("plain_text")


#: Aliases of formats on the command line.
FORMATS = {"auto": "auto", "openai": "openai_json", "openai-json": "openai_json", "anthropic": "anthropic_json", "anthropic-json": "anthropic_json", "json": "json", "text": "plain_text", "plain-text": "plain_text", "command": "command_output", "command-output": "command_output", "diff": "git_diff", "git-diff": "git_diff"}


def safe_component(c: Column | str) -> Column:
    """Whether a namespace may name a folder."""
    c = col(c)
    return (c != "") & ~c.contains("/") & ~c.contains("\\") & ~c.isin(".", "..")


def is_expired(stored_at: Column | str, ttl: Column | str, now: Column | int) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    return F.coalesce(F.greatest(now - col(stored_at), F.lit(0)) >= col(ttl), F.lit(False))


def marker_field(c: Column | str, name: str) -> Column:
    """A field of a retrieval marker; null where it is missing."""
    got = F.regexp_extract(col(c), rf"[\[ ]{name}=([^\s\]]*)", 1)
    return F.when(got != "", got)


def parse_format(c: Column | str) -> Column:
    """The format that an alias names, in any case; null for an unknown one."""
    names = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.get(F.array(F.try_element_at(names, F.lower(F.trim(col(c))))), F.lit(0))


def reference_kind(marker: Column | str, bare: Column | str, report: Column | str) -> Column:
    """Which of several references counts: a marker before a bare hash before a report, which can't be followed."""
    return F.when(col(marker).isNotNull(), "marker").when(col(bare).isNotNull(), "hash").when(col(report).isNotNull(), "unsupported")


def retrieval_reference(marker: Column | str, bare: Column | str) -> Column:
    """The hash asked for: that of the marker first, then a bare one, which must be hexadecimal and is lowered."""
    b = col(bare)
    return F.coalesce(F.lower(marker_field(marker, "hash")), F.when(b.rlike("^[0-9A-Fa-f]+$"), F.lower(b)))


def duration_seconds(c: Column | str) -> Column:
    """Seconds in 30d, 24h, 90m, 120s or a bare number; null if it is none of these, or does not fit in 64 bits. Products beyond the largest long become that."""
    c = F.trim(col(c))
    n = F.when(F.length(c) < 30, F.regexp_extract(c, "^([0-9]+)[dhms]?$", 1)).otherwise("")
    unit = F.when(c.endswith("d"), 86400).when(c.endswith("h"), 3600).when(c.endswith("m"), 60).otherwise(1)
    number = n.try_cast("decimal(30,0)")
    fits = (n != "") & (number <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(fits, F.least(number * unit.cast("decimal(6,0)"), F.lit("9223372036854775807").cast("decimal(36,0)")).cast("long"))


def format_timestamp(unix: Column | str) -> Column:
    """RFC 3339 in UTC, whole seconds, whatever the session's time zone."""
    u = col(unix).cast("long")
    day, rest = F.floor(u / 86400), F.pmod(u, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def parse_timestamp(c: Column | str) -> Column:
    """Seconds since 1970 of RFC 3339 in UTC with whole seconds; null for anything else."""
    c = col(c)
    part = lambda at: F.substring(c, at, 2).try_cast("int")
    seconds = F.unix_date(F.substring(c, 1, 10).try_cast("date")).cast("long") * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z$"), seconds)


def project_hash(path: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(path), 256))


def image_kind(c: Column | str) -> Column:
    """jpeg or png by the first bytes of a binary column; null for others."""
    h = F.hex(F.substring(col(c), 1, 8))
    return F.when(h.startswith("FFD8"), "jpeg").when(h == "89504E470D0A1A0A", "png")


def raw_capture_class(n: Column | str, filtered: Column | str, truncated: Column | str) -> Column:
    """How complete the capture of a command's raw output is, beside its filtered bytes."""
    return F.when(col(n) == 0, "unavailable").when(col(truncated) | (col(n) < col(filtered)), "partial").otherwise("complete")
