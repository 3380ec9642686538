"""JSON rewrites as column functions: Arrow batches go through the strict kernel, so spelling and order are kept.

Null stays null; a payload that isn't JSON gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsimony.functions import json_tree as jt
from parsimony.functions.batches import bounded, by_pieces
from parsimony.functions.text import col
from parsimony.operators import prune as P


def _pairs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


def _mapped(values: pa.Array, f: Callable[[str], Any], kind: pa.DataType) -> pa.Array:
    """f of each distinct value of a piece, once."""

    def piece(xs: list[str | None]) -> list:
        known: dict[str | None, Any] = {None: None}
        for x in xs:
            if x not in known:
                try:
                    known[x] = f(x)
                except jt.JsonError:
                    known[x] = None
        return [known[x] for x in xs]

    return by_pieces(piece, kind, values)


def column_function(f: Callable[[str], str | None]) -> Callable[[Column | str], Column]:
    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return _mapped(values, f, pa.string())

    def call(c: Column | str) -> Column:
        return bounded(run, col(c))

    call.udf = run
    return call


def _value_dict(text: str) -> str:
    v = jt.value_dictionary(jt.loads(text))
    return text if v is None else jt.dumps(v)


#: White space outside strings goes.
minify = column_function(jt.minify)
#: Arrays of objects with one set of keys as columns and rows, and back.
field_fold = column_function(lambda t: jt.dumps(jt.fold(jt.loads(t))))
field_unfold = column_function(lambda t: jt.dumps(jt.unfold(jt.loads(t))))
#: Long values that repeat as references into a table (a payload without any stays as it is), and back.
value_dict = column_function(_value_dict)
value_undict = column_function(lambda t: jt.dumps(jt.undictionary(jt.loads(t))))
#: Arrays under "examples" cut to one item.
schema_compact = column_function(lambda t: jt.dumps(jt.shorten_examples(jt.loads(t))))


def marker(c: Column | str, namespace: str = "default") -> Column:
    """The marker of an item's text."""
    return column_function(lambda t: jt.dumps(P.marker(t, namespace)))(c)


def protected_segments(c: Column | str, fmt: str) -> Column:
    """What no rewrite of a payload of this format may lose."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(values: pa.Array) -> pa.Array:
        return _mapped(values, lambda t: jt.protected_segments(t, fmt), pa.list_(pa.string()))

    return bounded(run, col(c))


def shape_kept(before: Column | str, after: Column | str, fmt: str) -> Column:
    """Whether a provider payload kept its messages' number, roles and calls."""

    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return by_pieces(lambda xs, ys: [None if x is None or y is None else jt.shape_kept(x, y, fmt) for x, y in zip(xs, ys, strict=True)], pa.bool_(), a, b)

    return bounded(run, col(before), col(after))


def prune(c: Column | str, ratio: float, preserve: Sequence[str] = (), namespace: str = "default") -> Column:
    """out, total, and dropped (hash and body of each item that gave way to its marker); out is the payload itself where nothing is dropped."""
    preserve = tuple(preserve)

    def one(text: str) -> dict:
        got = P.prune(text, ratio, preserve, namespace)
        if got is None:
            return {"out": text, "total": 0, "dropped": []}
        return {"out": got.text, "total": got.total, "dropped": [{"hash": h, "body": b} for h, b in got.dropped]}

    kind = pa.struct([("out", pa.string()), ("total", pa.int32()), ("dropped", pa.list_(pa.struct([("hash", pa.string()), ("body", pa.string())])))])

    @F.arrow_udf(T.StructType([T.StructField("out", T.StringType()), T.StructField("total", T.IntegerType()), T.StructField("dropped", _pairs("hash", "body"))]))
    def run(values: pa.Array) -> pa.Array:
        return _mapped(values, one, kind)

    return bounded(run, col(c))


def markers(c: Column | str) -> Column:
    """namespace and hash of each marker in a payload, in order, once each."""

    def found(v: Any, out: dict) -> dict:
        if P.is_marker(v):
            out[v["$tf_ref"]["namespace"], v["$tf_ref"]["hash"]] = True
        elif isinstance(v, dict):
            for x in v.values():
                found(x, out)
        elif isinstance(v, list):
            for x in v:
                found(x, out)
        return out

    kind = pa.list_(pa.struct([("namespace", pa.string()), ("hash", pa.string())]))

    @F.arrow_udf(_pairs("namespace", "hash"))
    def run(values: pa.Array) -> pa.Array:
        return _mapped(values, lambda t: [{"namespace": n, "hash": h} for n, h in found(jt.loads(t), {})], kind)

    return bounded(run, col(c))


def revert(c: Column | str, bodies: Column | str) -> Column:
    """The payload with the items put back that bodies (array of hash and body) hold; other markers stay."""

    def piece(texts: list[str | None], found: list[list[dict] | None]) -> list[str | None]:
        return [t if t is None or not b else P.revert(t, {x["hash"]: x["body"] for x in b}) for t, b in zip(texts, found, strict=True)]

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return by_pieces(piece, pa.string(), texts, found)

    return bounded(run, col(c), col(bodies))
