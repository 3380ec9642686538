"""Edge cases of columns and operators, each with the result that is defined for it."""

import random

import pytest
from pyspark.sql import functions as F

from parsimony.functions import text as X
from parsimony.operators import binary, lines, ranking, store


def one(spark, expr, *values, schema="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {schema}").select(expr).collect()]


def test_lines_keep_a_carriage_return_that_no_newline_follows(spark):
    got = one(spark, X.lines("x"), "a\r\nb\r", "a\r\n", "", "\n", "a\n\nb", "a\r\r\n", None, " ")
    assert got == [["a", "b\r"], ["a"], [], [""], ["a", "", "b"], ["a\r"], None, [" "]]
    texts = ["a\r\nb\r", "a\r\n", "", "\n", "a\n\nb", "a\r\r\n", " "]
    assert [binary.split_lines(t) for t in texts] == one(spark, X.lines("x"), *texts)


def test_format_of_json_with_repeated_keys(spark):
    texts = ['{"a":1,"a":2}', '[{"a":1,"a":2}]', '{"messages":[{"role":"user","x":1,"x":2}]}', '{"a":1,"a":2} x', "{'a':1}", '{"a":NaN}', "42", '{"system":"s","messages":[{"role":"user"}]}', ""]
    want = ["json", "json", "openai_json", "plain_text", "plain_text", "plain_text", "plain_text", "anthropic_json", "plain_text"]
    assert one(spark, X.detect_format("x"), *texts) == want
    assert one(spark, X.detect_format_proxy("x"), *texts) == ["openai_json" if "messages" in t else "plain_text" for t in texts]


def test_durations_saturate(spark):
    got = one(spark, X.duration_seconds("x"), "999999999999999999d", "18446744073709551615", "18446744073709551616", "9" * 40 + "h", "2m", "", "d", None)
    assert got == [2**63 - 1, 2**63 - 1, None, None, 120, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [0, -1, 1_710_054_000, 951_782_400, 4_102_444_799]
        stamps = one(spark, X.format_timestamp("x"), *times, schema="long")
        assert stamps == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "2024-03-10T07:00:00Z", "2000-02-29T00:00:00Z", "2099-12-31T23:59:59Z"]
        assert one(spark, X.parse_timestamp("x"), *stamps, "2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "x") == [*times, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_words_keep_their_vowel_signs(spark):
    assert one(spark, ranking.tokenize_alnum(F.col("x")), "हिन्दी पाठ, Größe-2") == [["हिन", "दी", "पाठ", "größe", "2"]]


def test_replacements(spark):
    swap = lambda p, r: lines.Stage("replace", pattern=p, replacement=r).apply(F.col("x"))
    assert one(spark, swap("(a)(b)", "$2$5$1"), "xab") == ["xba"]
    assert one(spark, swap("(a)(b)", "${1}0$$\\$"), "ab") == ["a0$\\$"]
    assert lines.replacement("(a)", "${1}5") == "$1\\5" and lines.replacement("(a)", "$10") == ""


def test_pattern_safety():
    for p in ("(a+b)+", "(ab)+", "a+b*"):
        assert lines.check_pattern(p) == p
    for p in ("(a+)+", "(a*)*", "(a{2})+", "(a+){3}", "x" * 201):
        with pytest.raises(ValueError):
            lines.check_pattern(p)
    with pytest.raises(ValueError):
        lines.Filter("f", "1", ("x",), (), match_output="(a+)+")


def _table_diff(a, b):
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            best[i, j] = 0 if i == len(a) or j == len(b) else best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("equal", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1, j] >= best[i, j + 1]:
            out.append(("delete", a[i]))
            i += 1
        else:
            out.append(("insert", b[j]))
            j += 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_line_diff_is_that_of_the_whole_table(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
    assert binary.line_diff(a, b) == _table_diff(a, b)


def test_line_diff_of_long_texts():
    a = [f"l{i % 997}" for i in range(4000)]
    b = [x for i, x in enumerate(a) if i % 10] + ["end"]
    got = binary.line_diff(a, b)
    assert [x for t, x in got if t != "insert"] == a and [x for t, x in got if t != "delete"] == b


def test_line_diff_splits_at_newlines_only(spark):
    rows = spark.createDataFrame([(1, "a b\x0bc\x85d\r\ne", "a b\x0bc\x85d\ne")], "k long, before string, after string")
    assert [(r.tag, r.line) for r in binary.line_diffs(rows, "k").orderBy("pos").collect()] == [("equal", "a b\x0bc\x85d"), ("equal", "e")]


def test_a_later_write_wins_and_no_ttl_lasts_longest(spark):
    empty = spark.createDataFrame([], "namespace string, hash string, body string, stored_at long, ttl long, bytes long")
    rows = lambda *r: spark.createDataFrame(list(r), "namespace string, body string, stored_at long, ttl long")
    first = store.put(empty, rows(("n", "x", 5, 900), ("n", "x", 5, None), ("n", "y", 5, 100), ("n", "z", 9, 1)))
    assert {(r.body, r.ttl) for r in first.collect()} == {("x", None), ("y", 100), ("z", 1)}
    then = store.put(first, rows(("n", "x", 5, 10), ("n", "y", 6, 1), ("n", "z", 8, 99)))
    assert {(r.body, r.stored_at, r.ttl) for r in then.collect()} == {("x", 5, 10), ("y", 6, 1), ("z", 9, 1)}


def test_eviction_within_a_burst(spark):
    rows = [("n", f"{i:064x}"[::-1], "b", 1000 + (i % 3 if i < 40 else 8000 + i), None, 10) for i in range(60)]
    entries = spark.createDataFrame(rows, "namespace string, hash string, body string, stored_at long, ttl long, bytes long")
    for cap in (0, 5, 95, 205, 395, 600):
        got = store.gc(entries, 20_000, cap, parts=4).collect()
        assert sum(r.bytes for r in got) == min(cap // 10 * 10, 600)
        left = {r.hash for r in got}
        if left and len(left) < 60:
            assert min(r.stored_at for r in got) >= max(r[3] for r in rows if r[1] not in left)


def test_fixtures_and_tiers(spark):
    f = lines.Filter("f", "1", ("x",), (lines.Stage("keep_lines", pattern="a"),), fixtures=(lines.Fixture("good", "a b c d\nb b b b", "a b c d", 2), lines.Fixture("bad", "b", "b", 0)))
    got = {r.fixture: (r.output_matches, r.token_delta, r.passed) for r in lines.run_fixtures(spark, [f]).collect()}
    assert got == {"good": (True, 2, True), "bad": (False, 1, False)}
    assert lines.run_fixtures(spark, lines.BUILT_IN).where("not passed").count() == 0
    rows = spark.createDataFrame([(["git", "diff"], "index 0a b\n" * 30 + "x")], "argv array<string>, text string")
    own = lines.Filter("own", "1", ("git",), (lines.Stage("head", count=1),), tier=0)
    other = lines.Filter("other", "1", ("git",), (lines.Stage("tail", count=1),), tier=0)
    name = lambda fs: lines.apply_filters(rows, fs).first().filter_id
    assert name((*lines.BUILT_IN, own, other)) == "own" and name((*lines.BUILT_IN, lines.Filter("own", "1", ("git",), own.stages, tier=0, trusted=False))) == "git-diff"


def test_trust(spark, tmp_path):
    packs = spark.createDataFrame([("/p", "body", "1"), ("/q", "other", "1")], "path string, content string, schema_version string")
    none = lines.read_trust(spark, str(tmp_path / "missing.json"))
    assert lines.with_trust(packs, none).where("trusted").count() == 0
    known = lines.trust(none, packs.where("path = '/p'"))
    assert {r.path: r.trusted for r in lines.with_trust(packs, known).collect()} == {"/p": True, "/q": False}
    changed = spark.createDataFrame([("/p", "body2", "1"), ("/p", "body", "2")], packs.schema)
    assert lines.with_trust(changed, known).where("trusted").count() == 0
    assert [tuple(r) for r in lines.trust(known, changed.limit(1)).select("path", "schema_version").collect()] == [("/p", "1")]
    (tmp_path / "t.json").write_text('{"entries":[{"path":"/p","sha256":"x","schema_version":"1"}]}')
    (tmp_path / "bad.json").write_text("{")
    assert lines.read_trust(spark, str(tmp_path / "t.json")).collect() == [("/p", "x", "1")]
    assert lines.read_trust(spark, str(tmp_path / "bad.json")).count() == 0


def test_learned_selectors(spark):
    docs = spark.createDataFrame([(1, ["a\n", "bb\n", "a c"]), (2, [])], "doc_id long, units array<string>")
    size = lambda units, query: [len(u) + len(query) for u in units]
    got = ranking.unit_scores(docs, "size", ["q"], {"size": size}).collect()
    assert [(r.doc_id, r.pos, r.score) for r in got] == [(1, 0, 3.0), (1, 1, 4.0), (1, 2, 4.0)]
    with pytest.raises(ValueError, match="baselines"):
        ranking.unit_scores(docs, "size", (), {"recency": size})
    with pytest.raises(ValueError, match="unknown"):
        ranking.unit_scores(docs, "other")


def test_references_and_aliases(spark):
    rows = spark.createDataFrame([("m", "h", "r"), (None, "h", "r"), (None, None, "r"), (None, None, None)], "m string, h string, r string")
    assert [r[0] for r in rows.select(X.reference_kind("m", "h", "r")).collect()] == ["marker", "hash", "unsupported", None]
    assert one(spark, X.parse_format("x"), "OpenAI", " diff ", "nope", None) == ["openai_json", "git_diff", None, None]
    assert one(spark, X.raw_capture_class(F.lit(0), F.lit(5), F.lit(False)), "") == ["unavailable"]
    assert one(spark, X.raw_capture_class("x", F.lit(5), F.lit(False)), 4, 5, schema="long") == ["partial", "complete"]


def test_protected_contents_of_any_kind():
    from parsimony.functions import json_tree as jt

    parts = '[{"type":"text","text":"s"}]'
    assert jt.protected_segments('{"system": %s, "messages": [{"role":"user","content":"a"},{"role":"user","content":[1, 2]}]}' % parts, "anthropic_json") == [parts, "[1,2]"]
    assert jt.protected_segments('{"messages": [{"role":"system","content":null},{"role":"system"},{"role":"user","content":"u"},7]}', "openai_json") == ["null", "u"]
    assert jt.protected_segments('{"system": 3, "messages": 4}', "anthropic_json") == [] and jt.protected_segments("[", "openai_json") == []
