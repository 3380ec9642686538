"""Operators on the lines of a payload: run compaction, diff compaction, log folding and the filter language."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.functions.text import MARKER, col, lines, tokens

MIN_RUN = 3
# Leading timestamps that are dropped before lines are compared.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})[ \t]+"
SYSLOG_TIME = r"^[A-Z][a-z]{2}[ \t]+\d{1,2}[ \t]+\d{2}:\d{2}:\d{2}[ \t]+"
# What a folded log captures from its lines.
CAPTURED = "0x[0-9a-fA-F]+|[0-9]+"
# Prefixes of a diff's structural lines, and the header of a folded log.
DIFF_HEADS = ("diff --git", "index ", "--- ", "+++ ", "@@")
LOG_FOLD = "__tf_logfold1__"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; inside another lambda a plain column expression is computed for every item."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _runs(ls: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Begins (from 0) of runs in an array: places whose line differs from the one before."""
    n = F.size(ls)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | ~same(F.get(ls, i), F.get(ls, i - 1)))


def compact_log(text: Column | str, strip_timestamps: bool = False) -> Column:
    """Runs of three or more equal lines become the line, a count and the line again; all within the row, without a shuffle."""
    ls = lines(text)
    if strip_timestamps:
        ls = F.transform(ls, lambda x: F.when(x.rlike(ISO_TIME), F.regexp_replace(x, ISO_TIME, "")).otherwise(F.regexp_replace(x, SYSLOG_TIME, "")))

    def made(ls: Column, begins: Column) -> Column:
        spans = F.transform(begins, lambda b, k: F.struct(F.get(ls, b).alias("x"), (F.coalesce(F.get(begins, k + 1), F.size(ls)) - b).alias("n")))
        parts = F.transform(spans, lambda s: F.when(s["n"] >= MIN_RUN, F.array(s["x"], F.concat(F.lit("[repeated "), s["n"].cast("string"), F.lit("x]")), s["x"])).otherwise(F.array_repeat(s["x"], s["n"])))
        return F.array_join(F.flatten(parts), "\n")

    return let(ls, lambda v: let(_runs(v, lambda a, b: a == b), lambda w: made(v, w)))


def compact_diff(text: Column | str, keep_bodies: bool = True) -> Column:
    """Structural lines stay, bodies as asked; each run of other lines becomes one line that counts them."""
    what = "context lines" if keep_bodies else "lines"

    def kept(x: Column) -> Column:
        head = F.lit(False)
        for h in DIFF_HEADS:
            head = head | x.startswith(h)
        return head | x.startswith("+") | x.startswith("-") if keep_bodies else head

    def made(ls: Column, begins: Column) -> Column:
        parts = F.transform(begins, lambda b, k: F.when(F.get(ls, b)["k"], F.get(ls, b)["x"]).otherwise(F.concat(F.lit("["), (F.coalesce(F.get(begins, k + 1), F.size(ls)) - b).cast("string"), F.lit(f" {what} dropped]"))))
        return F.array_join(parts, "\n")

    ls = F.transform(lines(text), lambda x: F.struct(x.alias("x"), kept(x).alias("k")))
    return let(ls, lambda v: let(_runs(v, lambda a, b: ~a["k"] & ~b["k"]), lambda w: made(v, w)))


def fold_log(text: Column | str) -> Column:
    """Templates of lines once, then a row of template number and captured numbers for each line; null where it does not apply."""
    text = col(text)
    pattern = CAPTURED
    segs = F.filter(F.split(text, "(?<=\n)", -1), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, pattern, "\u0000")

    def made(segs: Column, templates: Column) -> Column:
        rows = F.transform(segs, lambda x: F.array_join(F.concat(F.array((F.array_position(templates, shape(x)) - 1).cast("string")), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))), " "))
        out = F.concat(F.lit(LOG_FOLD + "\n"), F.to_json(templates), F.lit("\n"), F.array_join(rows, "\n"))
        return F.when((F.size(segs) >= 3) & (F.size(templates) < F.size(segs)), out)

    folded = let(segs, lambda v: let(F.array_distinct(F.transform(v, shape)), lambda w: made(v, w)))
    return F.when(~text.contains("\u0000"), folded)


def unfold_log(folded: Column | str) -> Column:
    """The text that fold_log was given; null if a row's number or arity does not fit."""
    parts = F.split(col(folded), "\n", 3)
    rows = F.transform(F.split(F.get(parts, F.lit(2)), "\n", -1), lambda r: F.split(r, " ", -1))

    def line(r: Column, templates: Column) -> Column:
        pieces = F.split(F.get(templates, F.get(r, F.lit(0)).try_cast("int")), "\u0000", -1)
        caps = F.slice(r, 2, F.size(r) - 1)
        return F.when(F.size(pieces) == F.size(r), F.array_join(F.flatten(F.zip_with(pieces, caps, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), ""))

    made = let(F.from_json(F.get(parts, F.lit(1)), "array<string>"), lambda t: F.transform(rows, lambda r: line(r, t)))
    whole = let(made, lambda m: F.when(F.forall(m, lambda x: x.isNotNull()), F.array_join(m, "")))
    return F.when(F.get(parts, F.lit(0)).eqNullSafe(F.lit(LOG_FOLD)), whole)


# --- filters ---------------------------------------------------------------------------------


def check_pattern(pattern: str) -> str:
    """Rejects patterns that are long, or quantify a group whose own end is quantified, which a backtracking matcher may not survive."""
    if len(pattern.encode()) > 200:
        raise ValueError("pattern is longer than 200 bytes")
    if re.search(r"[*+}]\)[*+{]", pattern):
        raise ValueError("a group that ends in a quantifier is quantified again")
    re.compile(pattern)
    return pattern


def replacement(pattern: str, put: str) -> str:
    """put ($1, ${1}, $name, $$) for Java's matcher: groups that the pattern hasn't become empty."""
    groups = re.compile(pattern)

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return "\\" + m[0]
        n = int(name) if name.isdigit() else groups.groupindex.get(name)
        # braces end a number, so that a digit behind it stays text
        return "" if n is None or n > groups.groups else f"${n}\0"

    made = re.sub(r"\$\$|\$\{([^}]*)\}|\$([0-9A-Za-z_]+)|[$\\]", one, put)
    return re.sub("\0([0-9])", r"\\\1", made).replace("\0", "")


@dataclass(frozen=True)
class Stage:
    """A step of a filter: type and its arguments."""

    type: str
    pattern: str = ""
    replacement: str = ""
    count: int = 0
    value: str = ""

    def apply(self, text: Column) -> Column:
        ls = lines(text)
        if self.type == "strip_ansi":
            return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")
        if self.type == "replace":
            return F.regexp_replace(text, check_pattern(self.pattern), replacement(self.pattern, self.replacement))
        if self.type == "keep_lines":
            p = check_pattern(self.pattern)
            return F.array_join(F.filter(ls, lambda x: x.rlike(p)), "\n")
        if self.type == "strip_lines":
            p = check_pattern(self.pattern)
            return F.array_join(F.filter(ls, lambda x: ~x.rlike(p)), "\n")
        if self.type == "head":
            return F.array_join(F.slice(ls, 1, self.count), "\n")
        if self.type == "tail":
            return F.array_join(F.slice(ls, F.greatest(F.size(ls) - self.count, F.lit(0)) + 1, F.lit(self.count)), "\n")
        if self.type == "max_lines":
            kept = F.concat(F.array_join(F.slice(ls, 1, self.count), "\n"), F.lit(f"\n... [{MARKER}: truncated "), (F.size(ls) - self.count).cast("string"), F.lit(" more lines]"))
            return F.when(F.size(ls) > self.count, kept).otherwise(text)
        if self.type == "truncate":
            raw = text.cast("binary")
            # back from the limit to a byte that begins a character
            ends = F.sequence(F.lit(self.count), F.lit(max(0, self.count - 3)))
            begins = F.filter(ends, lambda e: (e == 0) | ~F.hex(F.substring(raw, e + 1, F.lit(1))).rlike("^[89AB]"))
            cut = F.substring(raw, F.lit(1), F.get(begins, F.lit(0)))
            return F.when(F.octet_length(text) > self.count, F.concat(cut.cast("string"), F.lit(f"... [{MARKER}: truncated]"))).otherwise(text)
        if self.type == "on_empty":
            return F.when(text == "", F.lit(self.value)).otherwise(text)
        raise ValueError(f"unknown stage {self.type}")


@dataclass(frozen=True)
class Fixture:
    """What a filter makes of an input, and how many tokens it saves."""

    name: str
    input: str
    output: str
    token_delta: int


@dataclass(frozen=True)
class Filter:
    id: str
    version: str
    match_command: tuple[str, ...]
    stages: tuple[Stage, ...]
    match_output: str | None = None
    tier: int = 2  # project 0, user 1, built-in 2
    fixtures: tuple[Fixture, ...] = ()
    trusted: bool = True

    def __post_init__(self) -> None:
        for p in (self.match_output, *(s.pattern for s in self.stages)):
            if p:
                check_pattern(p)

    def matches(self, argv: Column, output: Column) -> Column:
        n = len(self.match_command)
        ok = F.slice(argv, 1, n) == F.array(*(F.lit(x) for x in self.match_command)) if n else F.lit(False)
        return ok & output.rlike(self.match_output) if self.match_output else ok

    def apply(self, text: Column | str) -> Column:
        text = col(text)
        for s in self.stages:
            text = s.apply(text)
        return text


def never_worse(raw: Column | str, filtered: Column | str) -> Column:
    """The filtered text only where it has fewer tokens."""
    return F.when(tokens(filtered) < tokens(raw), col(filtered)).otherwise(col(raw))


# The built-in packs.
BUILT_IN = (
    Filter("git-diff", "1.0.0", ("git", "diff"), (Stage("strip_ansi"), Stage("strip_lines", pattern=r"^index [0-9a-f]"), Stage("max_lines", count=500))),
    Filter("git-status", "1.0.0", ("git", "status"), (Stage("strip_ansi"), Stage("strip_lines", pattern=r"^\s*\(use "), Stage("max_lines", count=200))),
    Filter("cargo", "1.0.0", ("cargo",), (Stage("strip_ansi"), Stage("strip_lines", pattern=r"^\s*(Compiling|Downloaded|Fresh|Downloading) "), Stage("max_lines", count=300))),
)


def apply_filters(df: DataFrame, filters: tuple[Filter, ...] = BUILT_IN, argv: str = "argv", text: str = "text") -> DataFrame:
    """df with filter_id (of the first match, project before user before built-in, untrusted ones left out) and filtered, never worse than text."""
    rule, out = F.lit(None).cast("string"), F.col(text)
    found = sorted((f for f in filters if f.trusted), key=lambda f: f.tier)
    for f in reversed(found):  # the first in order is asked first
        hit = f.matches(F.col(argv), F.col(text))
        rule, out = F.when(hit, f.id).otherwise(rule), F.when(hit, f.apply(text)).otherwise(out)
    return df.withColumn("filter_id", rule).withColumn("filtered", never_worse(text, out))


def run_fixtures(spark: SparkSession, filters: Sequence[Filter]) -> DataFrame:
    """filter_id, fixture, output_matches, token_delta, expected_delta and passed for each fixture of the filters."""
    parts = []
    for f in filters:
        if f.fixtures:
            rows = spark.createDataFrame([(f.id, x.name, x.input, x.output, x.token_delta) for x in f.fixtures], "filter_id string, fixture string, input string, expected string, expected_delta long")
            parts.append(rows.withColumn("out", f.apply("input")))
    if not parts:
        return spark.createDataFrame([], "filter_id string, fixture string, output_matches boolean, token_delta long, expected_delta long, passed boolean")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    match, delta = F.col("out") == F.col("expected"), tokens("input") - tokens("out")
    return both.select("filter_id", "fixture", match.alias("output_matches"), delta.alias("token_delta"), "expected_delta", (match & (delta == F.col("expected_delta"))).alias("passed"))


# --- trust -------------------------------------------------------------------------------------

TRUST = "path string, sha256 string, schema_version string"


def trust(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """entries after packs (path, content, schema_version) were trusted; a pack replaces what was trusted at its path."""
    new = packs.select("path", F.sha2("content", 256).alias("sha256"), "schema_version")
    return entries.join(new, "path", "left_anti").select("path", "sha256", "schema_version").unionByName(new)


def with_trust(packs: DataFrame, entries: DataFrame) -> DataFrame:
    """packs with trusted: whether path, content and schema version all are as they were trusted."""
    known = entries.select("path", "sha256", "schema_version").distinct().withColumn("__known", F.lit(True))
    hashed = packs.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(known, ["path", "sha256", "schema_version"], "left").withColumn("trusted", F.coalesce("__known", F.lit(False))).drop("__known", "sha256")


def read_trust(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a trust file (JSON with a list, entries); nothing is trusted where it is missing or can't be read."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], TRUST)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.inline(F.coalesce(F.from_json("value", f"entries array<struct<{TRUST.replace(' string', ': string')}>>")["entries"], F.array().cast(f"array<struct<{TRUST.replace(' string', ': string')}>>"))))
