"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from parsimony import queries
from parsimony.functions import text as X

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.Q[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(queries.SQL[name])
    at = {x[0]: i for i, x in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.Q) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.Q[name](spark, DATA).count() > 0


def test_line_diff_takes_every_turn(spark):
    rows = [(1, 0, "a\nb"), (1, 1, "a\nc"), (1, 2, "c"), (1, 5, None), (2, 0, "x")]
    got = {tuple(r) for r in queries.turn_diffs(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    want = {(1, 0, 0, "equal", "a"), (1, 0, 1, "delete", "b"), (1, 0, 2, "insert", "c"), (1, 1, 0, "delete", "a"), (1, 1, 1, "equal", "c"), (1, 2, 0, "delete", "c"), (2, 0, 0, "delete", "x")}
    assert got == want
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    pairs = turns.selectExpr("conv_id", "turn", "row_number() over (partition by conv_id order by turn desc) as back").where("back > 1").select("conv_id", "turn")
    assert pairs.join(turns.where("text <> ''").select("conv_id", "turn"), ["conv_id", "turn"]).exceptAll(queries.Q["line_diff"](spark, DATA).select("conv_id", "turn").distinct()).count() == 0


def test_truncation_of_every_text(spark):
    import hashlib

    def cut(t):
        raw = t.encode()
        return t if len(raw) <= 50 else raw[:50].decode("utf-8", "ignore") + f"... [{X.MARKER}: truncated]"

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id", "text").collect()}
    assert any(len(t) != len(t.encode()) for t in texts.values())
    got = {r.doc_id: r.truncated for r in queries.Q["filter_truncate"](spark, DATA).collect()}
    assert {i: got[i] for i in texts} == {i: hashlib.sha256(cut(t).encode()).hexdigest() for i, t in texts.items()}
