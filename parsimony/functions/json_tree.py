"""Byte-exact JSON work on single payloads, for use inside Arrow functions.

Spark's own JSON functions re-spell numbers and may sort keys, so rewrites that must keep both run here: strict
parsing, compact writing, minify, field fold, value dictionary, schema compaction, and the inverses and gates.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import Any

# Reserved keys on the wire and sizes from which a rewrite pays.
COLS, ROWS, REF, DICT, DATA = "__tf_cols__", "__tf_rows__", "__tf_ref__", "__tf_dict__", "__tf_data__"
MIN_ROWS, MIN_VALUE_BYTES, MIN_COUNT, MAX_DEPTH = 2, 24, 2, 128
_U64, _I64 = 2**64 - 1, -(2**63)


class JsonError(ValueError):
    pass


class Whole(float):
    """A number spelled as an integer beyond 64 bits, which counts as a float."""


def _int(text: str) -> int | float:
    n = int(text) if len(text) < 25 else None
    if text == "-0":
        return -0.0
    return n if n is not None and _I64 <= n <= _U64 else _float(text)


def _float(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise JsonError("number out of range")
    return x


def _constant(text: str) -> None:
    raise JsonError(f"{text} is not JSON")


_LONE = re.compile("[\ud800-\udfff]")


def loads(raw: str | bytes) -> Any:
    """Strict: no NaN, no lone surrogates, at most MAX_DEPTH levels; of repeated keys the last counts, in the first one's place."""
    try:
        text = raw.decode() if isinstance(raw, bytes) else raw
        v = json.loads(text, parse_int=_int, parse_float=_float, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)) from None
    if depth(v) > MAX_DEPTH or _has_lone(v):
        raise JsonError("too deep, or a lone surrogate")
    return v


def depth(v: Any) -> int:
    most, level = 0, [v]
    while level:
        nxt = [x for c in level if isinstance(c, (dict, list)) for x in (c.values() if isinstance(c, dict) else c)]
        most += any(isinstance(c, (dict, list)) for c in level)
        level = nxt
    return most


def _has_lone(v: Any) -> bool:
    if isinstance(v, str):
        return bool(_LONE.search(v))
    if isinstance(v, dict):
        return any(_LONE.search(k) or _has_lone(x) for k, x in v.items())
    return isinstance(v, list) and any(map(_has_lone, v))


def _number(x: float) -> str:
    """Shortest spelling; exponents without plus sign or leading zeros."""
    return re.sub(r"e([+-]?)0*(\d)", lambda m: "e" + m[1].replace("+", "") + m[2], repr(x))


_quote = json.JSONEncoder(ensure_ascii=False).encode


def dumps(v: Any) -> str:
    if isinstance(v, str):
        return _quote(v)
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, list):
        return "[" + ",".join(map(dumps, v)) + "]"
    return "{" + ",".join(f"{_quote(k)}:{dumps(x)}" for k, x in v.items()) + "}"


def equal(a: Any, b: Any) -> bool:
    """Equal values; keys in any order, numbers of one kind only."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(x, b[k]) for k, x in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


_OUTSIDE = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+', re.S)


def minify(text: str) -> str:
    """White space outside strings goes; spelling and order stay. Empty stays empty; JsonError if it isn't JSON."""
    if not text:
        return ""
    loads(text)
    return _OUTSIDE.sub(lambda m: m[1] or "", text)


def _foldable(items: list) -> bool:
    if len(items) < MIN_ROWS or not all(isinstance(x, dict) and x for x in items):
        return False
    first = items[0].keys()
    return COLS not in first and ROWS not in first and all(x.keys() == first for x in items[1:])


def fold(v: Any) -> Any:
    """Arrays of objects with one set of keys become columns and rows, innermost first."""
    if isinstance(v, dict):
        return {k: fold(x) for k, x in v.items()}
    if not isinstance(v, list):
        return v
    inner = [fold(x) for x in v]
    if not _foldable(inner):
        return inner
    cols = list(inner[0])
    return {COLS: cols, ROWS: [[x[c] for c in cols] for x in inner]}


def unfold(v: Any) -> Any:
    if isinstance(v, list):
        return [unfold(x) for x in v]
    if not isinstance(v, dict):
        return v
    cols, rows = v.get(COLS), v.get(ROWS)
    if len(v) == 2 and isinstance(cols, list) and isinstance(rows, list) and all(isinstance(c, str) for c in cols) and all(isinstance(r, list) and len(r) == len(cols) for r in rows):
        return [dict(zip(cols, map(unfold, r), strict=True)) for r in rows]
    return {k: unfold(x) for k, x in v.items()}


def _key(v: Any) -> str | None:
    if isinstance(v, (dict, list, str)):
        s = dumps(v)
        if len(s.encode()) >= MIN_VALUE_BYTES:
            return s
    return None


def _children(v: Any) -> list:
    return list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []


def value_dictionary(v: Any) -> Any | None:
    """Long values that repeat, outermost first, as references into a table; None if there is none."""
    counts: Counter = Counter()
    todo = [v]
    while todo:
        x = todo.pop()
        if (k := _key(x)) is not None:
            counts[k] += 1
        todo.extend(_children(x))
    table: dict[str, int] = {}

    def put(x: Any) -> Any:
        k = _key(x)
        if k is not None and counts[k] >= MIN_COUNT:
            return {REF: table.setdefault(k, len(table))}
        if isinstance(x, dict):
            return {a: put(b) for a, b in x.items()}
        return [put(b) for b in x] if isinstance(x, list) else x

    data = put(v)
    return {DICT: [loads(k) for k in table], DATA: data} if table else None


def undictionary(v: Any) -> Any:
    """References one step resolved; those out of range stay."""
    if not (isinstance(v, dict) and v.keys() == {DICT, DATA} and isinstance(v[DICT], list)):
        return v
    table = v[DICT]

    def back(x: Any) -> Any:
        if isinstance(x, dict):
            n = x.get(REF)
            if len(x) == 1 and type(n) is int and 0 <= n < len(table):
                return table[n]
            return {a: back(b) for a, b in x.items()}
        return [back(b) for b in x] if isinstance(x, list) else x

    return back(v[DATA])


def shorten_examples(v: Any, most: int = 1) -> Any:
    """Every array under a key "examples" is cut to `most` items, also inside items that stay."""
    if isinstance(v, dict):
        return {k: [shorten_examples(y, most) for y in x[:most]] if k == "examples" and isinstance(x, list) else shorten_examples(x, most) for k, x in v.items()}
    return [shorten_examples(x, most) for x in v] if isinstance(v, list) else v


def key_order(v: Any) -> list[str]:
    """All keys, depth first."""
    if isinstance(v, dict):
        return [y for k, x in v.items() for y in (k, *key_order(x))]
    return [y for x in v for y in key_order(x)] if isinstance(v, list) else []


def key_order_kept(before: str, after: str) -> bool:
    try:
        return key_order(loads(before)) == key_order(loads(after))
    except JsonError:
        return False


def _content(holder: dict, key: str) -> list[str]:
    """The content under a key: a string as it is, anything else as it is written; nothing if the key is missing."""
    if key not in holder:
        return []
    return [holder[key] if isinstance(holder[key], str) else dumps(holder[key])]


def protected_segments(text: str, fmt: str) -> list[str]:
    """What no rewrite may lose: system contents and the last user's, or a diff's headers."""
    if fmt == "git_diff":
        return [x + "\n" for x in text.split("\n") if x.startswith(("diff --git", "--- ", "+++ ", "@@"))]
    if fmt not in ("openai_json", "anthropic_json"):
        return []
    try:
        v = loads(text)
    except JsonError:
        return []
    if not isinstance(v, dict):
        return []
    messages = [m for m in v["messages"] if isinstance(m, dict)] if isinstance(v.get("messages"), list) else []
    if fmt == "anthropic_json":
        system = _content(v, "system") if isinstance(v.get("system"), (str, list)) else []
    else:
        system = [t for m in messages if m.get("role") == "system" for t in _content(m, "content")]
    users = [m for m in messages if m.get("role") == "user"]
    return system + (_content(users[-1], "content") if users else [])


def shape_kept(before: str, after: str, fmt: str) -> bool:
    """A provider payload keeps its messages' number, roles and calls, and for one provider its model."""
    try:
        a, b = loads(before), loads(after)
    except JsonError:
        return False
    ma, mb = (x.get("messages") if isinstance(x, dict) else None for x in (a, b))
    if not isinstance(ma, list) or not isinstance(mb, list) or len(ma) != len(mb):
        return False
    if fmt == "anthropic_json" and a.get("model") != b.get("model"):
        return False
    calls = ("tool_calls", "function_call")
    return all(isinstance(x, dict) and isinstance(y, dict) and x.get("role") == y.get("role") and all((c in x) <= (c in y) for c in calls) for x, y in zip(ma, mb, strict=True))
