"""Policy of a rewrite, and which transforms it runs on which format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("conservative", "balanced", "aggressive")
SCOPES = ("all", "general", "code_review", "change_summary", "debugging", "search", "extraction", "planning", "qa")
FORMATS = ("openai_json", "anthropic_json", "json", "plain_text", "command_output", "git_diff")


@dataclass(frozen=True)
class Entry:
    id: str
    enabled: tuple[bool, bool, bool]
    experimental: bool
    max_ratio: tuple[float, float, float]
    scopes: tuple[str, ...]
    formats: tuple[str, ...]
    version: str = "1.0.0"


_JSON3 = ("openai_json", "anthropic_json", "json")
# The transforms in the order in which they run, by mode (conservative, balanced, aggressive).
MATRIX = (
    Entry("json_minify", (True, True, True), False, (1.0, 1.0, 1.0), ("all",), _JSON3),
    Entry("json_field_fold", (False, True, True), False, (0.0, 1.0, 1.0), ("all",), ("json",)),
    Entry("json_value_dict", (False, True, True), False, (0.0, 1.0, 1.0), ("all",), ("json",)),
    Entry("schema_compaction", (True, True, True), False, (0.15, 0.30, 0.50), ("all",), ("openai_json", "anthropic_json")),
    Entry("log_field_fold", (False, False, False), True, (0.0, 1.0, 1.0), ("all",), ("plain_text", "command_output")),
    Entry("log_compaction", (False, True, True), False, (0.0, 0.65, 0.75), ("general", "change_summary"), ("plain_text", "command_output")),
    Entry("diff_compaction", (False, False, False), True, (0.0, 0.60, 0.70), ("code_review", "change_summary"), ("plain_text", "command_output", "git_diff")),
)


@dataclass(frozen=True)
class Policy:
    mode: str = "balanced"
    scope: str = "all"
    target_tokens: int | None = None
    experimental: bool = False
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    lossy: str | None = None
    lossy_ratio: float = 0.3
    preserve_paths: tuple[str, ...] = ()
    namespace: str = "default"
    backend: str = "filesystem"
    ttl_seconds: int | None = None
    alg: str = "sha256"
    store_originals: bool = False
    preview: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if "secret_redaction" in self.disabled:
            raise ValueError("secret redaction can't be disabled")
        if self.alg != "sha256":
            raise ValueError(f"unknown hash {self.alg}; the store knows sha256 alone")
        if not 0 <= self.lossy_ratio <= 1:
            raise ValueError("lossy_ratio lies between 0 and 1")
        if self.lossy is not None:
            if self.lossy != "json_prune" or self.backend != "filesystem":
                raise ValueError("lossy pruning needs the filesystem backend")
            if self.ttl_seconds is not None and self.ttl_seconds < 86_400:
                raise ValueError("lossy pruning needs a day of retention or more")

    def plan(self, fmt: str) -> list[Entry]:
        """Transforms for a format, in order."""
        m = MODES.index(self.mode)
        runs = lambda e: e.enabled[m] or (e.experimental and self.experimental) or (e.id in self.enabled and (not e.experimental or self.experimental))
        return [e for e in MATRIX if runs(e) and e.id not in self.disabled and ("all" in e.scopes or self.scope in e.scopes) and fmt in e.formats]

    def cap(self, e: Entry) -> float:
        return e.max_ratio[MODES.index(self.mode)]


def matrix(spark: SparkSession) -> DataFrame:
    rows = [(i, e.id, e.version, list(e.enabled), e.experimental, list(e.max_ratio), list(e.scopes), list(e.formats)) for i, e in enumerate(MATRIX)]
    return spark.createDataFrame(rows, "pos int, id string, version string, enabled array<boolean>, experimental boolean, max_ratio array<double>, scopes array<string>, formats array<string>")


def pipeline_for(spark: SparkSession, experimental: bool = False) -> DataFrame:
    """mode, scope, format, pos, id, max_ratio: every plan, from the constant matrix."""
    m = matrix(spark)
    rows = m.select("*", F.explode(F.lit(list(SCOPES))).alias("scope")).select("*", F.explode("formats").alias("format")).select("*", F.posexplode(F.lit(list(MODES))).alias("m", "mode"))
    runs = F.get("enabled", F.col("m")) | (F.col("experimental") & F.lit(experimental))
    ok = runs & (F.array_contains("scopes", "all") | F.array_contains("scopes", F.col("scope")))
    return rows.where(ok).select("mode", "scope", "format", "pos", "id", F.get("max_ratio", F.col("m")).alias("max_ratio"))
