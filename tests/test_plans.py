"""Lossy runs and the store, provider payloads, estimators, evaluation, reports, streams and sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parsimony.functions import estimators
from parsimony.functions import json_tree as jt
from parsimony.functions import text as X
from parsimony.operators import binary, evaluation, ledger, prune, ranking, store
from parsimony.operators import json_columns as J
from parsimony.plans import recover, surfaces
from parsimony.plans.compress import compress
from parsimony.plans.policy import Policy
from parsimony.sources import files
from parsimony.streaming import ledger as stream

NOW = 1_706_745_600
SECRET = "sk-" + "a" * 24


def items(n, secret=None):
    return json.dumps({"rows": [{"id": i, "note": " ".join(f"w{(i * k) % 97}x" for k in range(40)) + (f" {SECRET}" if i == secret else "")} for i in range(n)]})


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(1, items(30)), (2, items(12)), (3, '{"a":1}'), (4, "plain text"), (5, None), (6, "{bad")]
    return spark.createDataFrame(rows, "payload_id long, body string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], store.ENTRY)


def test_lossy_runs_come_back_whole(payloads, empty):
    policy = Policy(lossy="json_prune", lossy_ratio=0.1)
    receipts = compress(payloads, policy).cache()
    assert {r.payload_id for r in receipts.collect()} == {1, 2, 3, 4, 5, 6}
    after, settled = recover.persist(receipts, empty, policy, NOW)
    rows = {r.payload_id: r for r in settled.collect()}
    assert rows[1].quality == rows[2].quality == "unvalidated" and rows[3].quality is None and rows[1].compressed_tokens < rows[1].original_tokens
    assert rows[1].retrieval.marker_count == len(rows[1].dropped) > 0 and rows[1].retrieval.ttl_seconds == store.DEFAULT_TTL and rows[3].retrieval is None
    assert rows[1].retrieval.skipped_bytes == 0 and rows[1].retrieval.persisted_bytes == sum(len(d.body.encode()) for d in rows[1].dropped)
    back = {r.payload_id: r for r in recover.restore(settled.select("payload_id", "out").where("payload_id <= 3"), after, NOW).collect()}
    bodies = {r.payload_id: r.body for r in payloads.collect()}
    assert all(jt.equal(jt.loads(back[i].body), jt.loads(bodies[i])) for i in (1, 2, 3)) and back[1].n_found == back[1].n_markers == len({d.hash for d in rows[1].dropped})
    late = {r.payload_id: r for r in recover.restore(settled.select("payload_id", "out").where("payload_id = 1"), after, NOW + store.DEFAULT_TTL).collect()}
    assert late[1].n_found == 0 and late[1].body == rows[1].out


def test_what_the_store_lacks_stays(payloads, empty):
    policy = Policy(lossy="json_prune", lossy_ratio=0.1)
    receipts = compress(payloads.where("payload_id = 1"), policy)
    whole = recover.persist(receipts, empty, policy, NOW)[1].first()
    some = store.put(empty, recover.proposed(receipts, policy, NOW).orderBy("body").limit(5))
    part = recover.settle(receipts, some, policy).first()
    assert whole.compressed_tokens < part.compressed_tokens < whole.original_tokens and len(part.dropped) == part.retrieval.marker_count >= 5 > 0 and part.retrieval.skipped_bytes > 0
    assert {prune.marker(d.body, "default")["$tf_ref"]["hash"] for d in part.dropped} == {m.hash for m in J_markers(part.out)}
    none = recover.settle(receipts, empty, policy).first()
    assert none.out == receipts.first().lossless and none.retrieval is None and none.quality is None and none.dropped == []
    assert {t.status for t in none.transforms if t.id == "json_prune"} == {"rolled_back"}


def J_markers(text):
    class M:
        def __init__(self, h):
            self.hash = h

    found = []

    def walk(v):
        if prune.is_marker(v):
            found.append(M(v["$tf_ref"]["hash"]))
        elif isinstance(v, dict):
            list(map(walk, v.values()))
        elif isinstance(v, list):
            list(map(walk, v))

    walk(jt.loads(text))
    return found


def test_secrets_do_not_reach_the_store(spark, empty):
    rows = spark.createDataFrame([(1, items(30, secret=7))], "payload_id long, body string")
    policy = Policy(lossy="json_prune", lossy_ratio=0.0)
    after, settled = recover.persist(compress(rows, policy), empty, policy, NOW)
    assert after.where(X.contains_secret("body")).count() == 0 and SECRET not in settled.first().out


def test_pruning_that_does_not_pay_drops_nothing(spark, empty):
    rows = [{"id": i, "status": "fine", "note": "the same long text of every row, which folds away to nothing much " * 5} for i in range(40)]
    df = spark.createDataFrame([(1, json.dumps(rows))], "payload_id long, body string")
    policy = Policy(lossy="json_prune", lossy_ratio=0.95)
    r = compress(df, policy).first()
    assert {t.id: t.status for t in r.transforms}["json_prune"] == "rolled_back" and r.dropped == [] and r.lossless is None
    assert recover.proposed(compress(df, policy), policy, NOW).count() == 0


def test_store_in_a_folder(spark, payloads, tmp_path):
    policy = Policy(lossy="json_prune", lossy_ratio=0.1)
    path = str(tmp_path / "store")
    assert store.read_entries(spark, path).count() == 0
    for _ in range(2):  # written twice, read once
        settled = recover.persist_to(compress(payloads, policy), path, policy, NOW)
    got = recover.restore(settled.where("payload_id <= 2").select("payload_id", "out"), store.read_entries(spark, path), NOW)
    assert got.where("n_found = n_markers and n_markers > 0").count() == 2


def test_joins_with_the_store_send_nothing_to_the_driver(spark, payloads, empty, tmp_path):
    payloads.write.parquet(str(tmp_path / "p"))  # a file's size is what Spark guesses from
    payloads = spark.read.parquet(str(tmp_path / "p"))
    policy = Policy(lossy="json_prune", lossy_ratio=0.1)
    after, settled = recover.persist(compress(payloads, policy), empty, policy, NOW)
    back = recover.restore(settled.where("payload_id <= 3").select("payload_id", "out"), after, NOW)
    stored = recover.store_originals(payloads.withColumn("format", F.lit("json")), empty, policy, NOW)[1]
    for df in (settled, back, stored):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert back.where("n_found = n_markers").count() == 3


def test_originals(spark, payloads, empty):
    rows = payloads.withColumn("format", F.when(F.col("payload_id") < 4, "json").otherwise("plain_text")).union(spark.createDataFrame([(9, f"x {SECRET}", "plain_text")]))
    after, report = recover.store_originals(rows, empty, Policy(store_originals=True), NOW)
    got = {r.payload_id: (r.stored, r.persisted_bytes, r.skipped_bytes) for r in report.collect()}
    assert got[9] == (False, 0, 2 + len(SECRET)) and got[4] == (True, 10, 0) and got[5] == (True, 0, 0) and after.count() == 6
    assert {r.payload_id for r in recover.store_originals(rows, empty, Policy(lossy="json_prune"), NOW)[1].collect()} == {1, 2, 3}
    assert recover.store_originals(rows, empty, Policy(store_originals=True, preview=True), NOW)[1].count() == 0
    assert recover.store_originals(rows, empty, Policy(), NOW)[1].count() == 0


def test_provider_payloads(spark):
    chat = json.dumps({"model": "m", "messages": [{"role": "system", "content": "be  brief"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "x", "tool_calls": [{"id": 1}]}]}, indent=4)
    df = spark.createDataFrame([(1, chat)], "payload_id long, body string")
    for adapter in surfaces.ADAPTERS:
        r = surfaces.compress_for(df, adapter).first()
        assert r.shape_kept and r.compressed_tokens < r.original_tokens and json.loads(r.out) == json.loads(chat)
    assert surfaces.compress_openai_payload(df).first().format == "openai_json" and surfaces.compress_anthropic_payload(df).first().format == "anthropic_json"
    with pytest.raises(ValueError):
        surfaces.compress_for(df, "other")
    lost = spark.createDataFrame([(chat, chat.replace("tool_calls", "tool")), (chat, chat), (chat, chat.replace("assistant", "user")), (chat, "x")], "a string, b string")
    assert [r[0] for r in lost.select(J.shape_kept("a", "b", "openai_json")).collect()] == [False, True, False, False]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "assistant", None), (1, 1, "user", "u")], "conv_id long, turn int, role string, text string")
    assert json.loads(surfaces.compress_messages(turns).first().out) == {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": ""}]}
    assert json.loads(surfaces.compress_messages(turns, "anthropic_messages").first().out)["system"] == "s"


def test_preview_and_retrieval(spark, payloads, empty):
    assert "out" not in surfaces.inspect(payloads).columns and surfaces.inspect(payloads).count() == 6
    entries = store.put(empty, spark.createDataFrame([("default", "body", NOW, 100)], "namespace string, body string, stored_at long, ttl long"))
    h = entries.first().hash
    asked = spark.createDataFrame([(f"[{X.MARKER}:retrieve hash={h} alg=sha256 namespace=default bytes=4 ttl=100]", "00"), (None, h.upper()), (None, "0f"), (None, "zz")], "marker string, hash string")
    got = [(r.status, r.body) for r in surfaces.retrieve(asked, entries, NOW).collect()]
    assert sorted(got, key=repr) == sorted([("found", "body"), ("found", "body"), ("missing", None), ("invalid", None)], key=repr)
    assert {r.status for r in surfaces.retrieve(asked.where("marker is not null"), entries, NOW + 100).collect()} == {"expired"}


def test_sql_functions(spark):
    names = surfaces.register(spark)
    got = spark.sql(f"""SELECT parsimony_tokens('abcde') AS t, parsimony_redact('key {SECRET}') AS r, parsimony_contains_secret('{SECRET}') AS s, parsimony_minify('{{ "a" : [1, 2] }}') AS m, parsimony_field_unfold(parsimony_field_fold('[{{"a":1}},{{"a":2}}]')) AS f""").first()
    assert tuple(got) == (2, "key [REDACTED:api_key]", True, '{"a":[1,2]}', '[{"a":1},{"a":2}]') and len(names) == 9


def test_json_columns(spark):
    df = spark.createDataFrame([('{ "a": "x  y" }',), ("no",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(J.minify("x")).collect()] == ['{"a":"x  y"}', None, None, ""]
    chat = '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u1"},{"role":"user","content":"u2"}]}'
    one = spark.createDataFrame([(chat,)], "x string")
    assert one.select(J.protected_segments("x", "openai_json")).first()[0] == ["s", "u2"] and one.select(X.is_json("x")).first()[0]


def test_exact_estimator(spark):
    P = pytest.importorskip("public_tokenizers")
    e = estimators.Estimator(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "byte_bpe_50k")
    texts = ["hello world, hello", "", "é日本 <|endoftext|> 42", "x" * 500]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    enc = estimators.encoder(e.path, e.pattern)
    assert [r[0] for r in df.select(e.count("x")).collect()] == [*(len(enc.encode_ordinary(t)) for t in texts), None]
    assert [r[0] for r in df.select(estimators.Estimator().count("x")).collect()][:2] == [5, 0]
    r = df.select(e.info().alias("i"), e.warnings().alias("w"), estimators.Estimator().info().alias("j"), estimators.Estimator().warnings().alias("v")).first()
    assert tuple(r.i) == ("bpe", "byte_bpe_50k", True) and r.w == [] and tuple(r.j) == ("heuristic", None, False) and r.v == [estimators.HEURISTIC_WARNING]
    assert df.select(estimators.provenance(True), estimators.provenance(False), estimators.provenance(True, True)).first()[:] == ("measured", "heuristic", "estimated")


def test_evaluation(spark):
    rng = random.Random(4)
    rows = []
    for i in range(6):
        ls = [" ".join(rng.choice(["up", "down", "left", "mark", "over"]) for _ in range(8)) + f" n{k}\n" for k in range(20)]
        rows.append((f"f{i}", "".join(ls), "mark n7", ls[7].strip(), ["n7", "n12"]))
    rows.append(("json", items(30), "w5x", "", []))
    fixtures = spark.createDataFrame(rows, "id string, source string, query string, gold_answer string, critical_atoms array<string>")
    both = None
    for s in ranking.BASELINES:
        got = evaluation.selector_rows(fixtures, [0.1, 0.5], s)
        both = got if both is None else both.unionByName(got)
    both = both.cache()
    assert both.count() == 7 * 2 * len(ranking.BASELINES)
    comp = evaluation.compressor_rows(fixtures, [0.1, 0.5]).unionByName(evaluation.compressor_rows(fixtures, [0.1, 0.5], True)).cache()
    assert evaluation.baseline_gate(both, comp).count() == 0
    top = both.where("selector = 'keep_all'").collect()
    assert all(r.task_success == 1 and r.achieved_ratio == 1 for r in top)
    broken = both.withColumn("survival", F.when(F.col("selector") == "recency", 0.5).otherwise(F.col("survival")))
    larger = comp.withColumn("achieved_tokens", F.when(F.col("selector") == "lossy", 10**6).otherwise(F.col("achieved_tokens")))
    assert {r.check for r in evaluation.baseline_gate(broken, larger).collect()} == {"atoms_survive", "lossy_not_larger"}
    report = ranking.baseline_report(both)
    assert report.where("mean_survival < 1").count() == 0


def test_report_files_and_export(spark, tmp_path):
    report = {"format": "json", "mode": "balanced", "status": "compressed", "original_tokens": 100, "compressed_tokens": 60, "saved_tokens": 40, "savings_pct": 40.0, "retrieval": {"marker_count": 3}}
    (tmp_path / "a1.json").write_text(json.dumps(report))
    (tmp_path / "a2.json").write_text(json.dumps(report | {"command": {"never_worse_applied": True}, "retrieval": None}))
    (tmp_path / "a3.json").write_text("{}")
    (tmp_path / "b.json").write_text(json.dumps(report))
    (tmp_path / "a4.json").write_text("nonsense")
    got = files.read_reports(spark, str(tmp_path), "a?.json")
    assert sorted((r.surface, r.bypass_reason, r.markers, r.request_id[:3]) for r in got.collect()) == [("cli", None, 3, "tc-"), ("wrap", "would_increase_tokens", 0, "tc-")]
    path = str(tmp_path / "ledger")
    assert files.read_ledger(spark, path).count() == 0
    files.append_ledger(got.drop("markers"), path)
    files.append_ledger(got.drop("markers").limit(1), path)
    (tmp_path / "ledger" / "part-x.json").write_text("{broken\n")
    records = files.read_ledger(spark, path)
    assert records.count() == 3
    s = ledger.stats(records, got.drop("markers")).first()
    assert (s.requests, s.raw_tokens, s.scope, s.cache_hits, s.untrusted_filter_count) == (5, 500, "stats", 0, 0)
    summary, latest = ledger.session(records, 2)
    lines = [r.line for r in ledger.summary_csv(summary, latest).orderBy("pos").collect()]
    assert lines[0] == ",".join(ledger.SUMMARY) and lines[1].startswith(",session,,,3,") and lines[2] == "" and lines[3] == ",".join(ledger.REQUESTS) and len(lines) == 6


def test_payload_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("héllo\n")
    (tmp_path / "in" / "y.log").write_text("no")
    got = files.read_payloads(spark, str(tmp_path / "in"), "*.txt").select("body").collect()
    assert [r.body for r in got] == ["héllo\n"]
    files.write_payloads(spark.createDataFrame([("a",), ("b",)], "out string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_images(spark):
    png = binary.PNG + b"\x00\x00\x00\x01tEXtx\x00\x00\x00\x00" + b"\x00\x00\x00\x00IEND\x00\x00\x00\x00"
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"\xff\xd8\xff\xda rest")), (3, bytearray(b"gif")), (4, None)], "k int, content binary")
    rows = {r.k: r for r in binary.strip_images(df).select("*", X.image_kind("content").alias("kind")).collect()}
    assert rows[1].kind == "png" and bytes(rows[1].stripped) == binary.PNG + b"\x00\x00\x00\x00IEND\x00\x00\x00\x00"
    assert rows[2].kind == "jpeg" and bytes(rows[2].stripped) == b"\xff\xd8\xff\xda rest" and rows[3].kind is None and rows[3].error and rows[4].stripped is None


def test_stream_drops_late_records_and_resumes(spark, tmp_path):
    def put(name, *times):
        rows = [{"request_id": t, "timestamp": t, "mode": "m", "original_tokens": 10, "saved_tokens": 1} for t in times]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)) + "\n")

    def run():
        q = stream.write(stream.windows(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()

    put("1.json", "2024-01-01T00:10:00Z", "2024-01-01T00:50:00Z", "nonsense")
    run()
    put("2.json", "2024-01-01T03:00:00Z")
    run()
    put("3.json", "2024-01-01T00:55:00Z", "2024-01-01T03:30:00Z")  # the first is too late
    run()
    put("4.json", "2024-01-01T09:00:00Z")
    run()
    put("5.json", "2024-01-01T09:01:00Z")
    run()
    got = sorted((r.window_start - 1704067200, r.requests, r.saved_tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2, 2), (10800, 2, 2)]
