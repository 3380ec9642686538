"""Token estimators: the byte heuristic, and exact BPE counts by a public rank file."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsimony.functions.text import col, tokens

HEURISTIC_WARNING = "token counts are estimated from bytes"


@dataclass(frozen=True)
class Estimator:
    """How tokens are counted: by bytes, or exactly by the ranks at `path` (base64 token and rank in each line) after splitting with `pattern`."""

    path: str | None = None
    pattern: str = r"[\s\S]+"
    model: str | None = None

    @property
    def is_exact(self) -> bool:
        return self.path is not None

    def count(self, c: Column | str) -> Column:
        """Tokens of a payload; special strings in it are ordinary text. Null stays null."""
        return exact_tokens(self.path, self.pattern)(col(c)) if self.path else tokens(c)

    def info(self) -> Column:
        return F.struct(F.lit("bpe" if self.is_exact else "heuristic").alias("backend"), F.lit(self.model).cast("string").alias("model"), F.lit(self.is_exact).alias("is_exact"))

    def warnings(self) -> Column:
        return F.array(*([] if self.is_exact else [F.lit(HEURISTIC_WARNING)])).cast("array<string>")


def provenance(is_exact: Column | bool, derived: Column | bool = False) -> Column:
    """measured or heuristic, as tokens were counted; estimated for what is derived from other figures."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(as_col(derived), "estimated").when(as_col(is_exact), "measured").otherwise("heuristic")


_encoders: dict = {}


def encoder(path: str, pattern: str):
    """One encoder for each worker and rank file."""
    import tiktoken

    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def exact_tokens(path: str, pattern: str) -> Callable[[Column], Column]:
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        e = encoder(path, pattern)
        return pa.array([None if t is None else len(e.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return run
