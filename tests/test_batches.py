"""What Python workers hold at once is bounded, however large the batches are that reach them."""

import json
import tracemalloc

import pyarrow as pa
import pytest

from parsimony import queries
from parsimony.functions import batches
from parsimony.operators import json_columns as J
from parsimony.operators import ranking
from parsimony.plans import compress as plan
from parsimony.plans.policy import Policy

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def wide(spark):
    """The session as Spark makes it, batches of 64 MB."""
    spark.conf.set(BYTES, "64m")
    yield spark
    batches.bound_batches(spark)


def payload(k, n=40):
    return json.dumps({"rows": [{"event_id": k * n + i, "value": i * 7 % 13, "note": f"{k}-{i} " * 60} for i in range(n)]})


def peak(f, *a):
    """What f gives, and the most MB of Python objects that it had at once."""
    tracemalloc.start()
    try:
        return f(*a), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_pieces():
    xs = pa.array(["a" * 10, None, "b" * 5000, "", "c" * 300, "d" * 300], pa.string())
    ys = pa.array([["x"], None, ["y" * 100] * 3, [], ["z"], None], pa.list_(pa.string()))
    for limit in (1, 700, 1 << 20):
        got = list(batches.pieces([xs, ys], limit))
        assert all(len(a) == len(b) and (len(a) == 1 or a.nbytes + b.nbytes <= limit) for a, b in got)
        assert [x for a, _ in got for x in a.to_pylist()] == xs.to_pylist() and [y for _, b in got for y in b.to_pylist()] == ys.to_pylist()
    assert [len(a) for a, in batches.pieces([xs.slice(0, 0)])] == [0]
    assert batches.by_pieces(lambda v: v, pa.string(), xs.slice(0, 0)).to_pylist() == []


def test_json_columns_hold_a_piece_of_their_batch(spark, monkeypatch):
    texts = [payload(k) for k in range(800)]
    texts[3], texts[5] = None, "{bad"
    batch = pa.array(texts)
    assert batch.nbytes > 8 << 20
    assert peak(J.minify.udf.func, batch)[1] < 6
    made = []
    monkeypatch.setattr(J, "bounded", lambda run, *columns: made.append(run.func))
    J.prune("x", 0.3)
    pruned, most = peak(made[0], batch)
    assert most < 6 and pruned[3].as_py() is None and pruned[5].as_py() is None and all(r["dropped"] for r in pruned.slice(6).to_pylist())
    J.revert("x", "y")
    back, most = peak(made[1], pruned.field("out"), pruned.field("dropped"))
    assert most < 8 and back.slice(6).to_pylist() == [json.dumps(json.loads(t), separators=(",", ":")) for t in texts[6:]]


def test_json_columns_bound_their_batches(wide):
    for make in (lambda: J.minify("x"), lambda: J.prune("x", 0.3), lambda: J.revert("x", "y"), lambda: J.markers("x")):
        wide.conf.set(BYTES, "64m")
        make()
        assert int(wide.conf.get(BYTES)) == batches.BATCH_BYTES


@pytest.mark.parametrize("name", ["json_prune", "json_prune_counts", "lossy_restore"])
def test_queries_bound_their_batches(wide, name):
    queries.Q[name](wide, "/root/testdata/sf0.001")
    assert int(wide.conf.get(BYTES)) == batches.BATCH_BYTES


def test_compress_holds_a_piece_of_its_batch(spark):
    texts = [payload(k) for k in range(800)]
    run = plan._json_result(Policy(lossy="json_prune", lossy_ratio=0.2)).func
    got, most = peak(run, pa.array([*texts, None]), pa.array(["json"] * len(texts) + ["plain_text"]))
    assert most < 6 and len(got) == len(texts) + 1 and got[-1].as_py() is None
    assert all(r["dropped"] and len(r["out"]) < len(t) for r, t in zip(got.to_pylist(), texts))


@pytest.mark.parametrize("selector", ["frequency", "surprisal", "bm25"])
def test_selectors_hold_a_piece_of_their_batch(wide, monkeypatch, selector):
    made = []
    docs = wide.createDataFrame([(1, ["a"])], "doc_id long, units array<string>")
    original = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(f) or original(self, f, schema))
    ranking.unit_scores(docs, selector, ["w3"])
    assert int(wide.conf.get(BYTES)) == batches.BATCH_BYTES
    units = [[f"w{(i * k) % 17} line {i} of text {k} w{i}\n" for i in range(100)] for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(units)], names=["doc_id", "units"])
    assert batch.nbytes > 8 << 20
    got, most = peak(lambda: [(b.num_rows, b.column(2).to_pylist()[0][:2]) for b in made[0](iter([batch]))])
    assert most < 12 and sum(n for n, _ in got) == 3000 and all(len(s) == 2 for _, s in got)
