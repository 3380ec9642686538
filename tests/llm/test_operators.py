"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import pickle
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parsimony.llm import ann, common, decontaminate, lm_scoring, minhash, packing, pii, suffix_dedup, token_counts, toxicity, warc
from parsimony.llm.common import shared_dir, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba to ri lu ne".split() for b in "sa mo ki the of zu".split()]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def frame(spark, texts, parts=3, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for c in ("key", "score", "spans", "bands", "n_tokens", "row", "term"):  # names that operators use themselves
        if c in more:
            df = df.withColumn(c, F.lit(more[c]))
    return df


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = prose(rng, 120)
    out = [(i, prose(rng, rng.randint(1, 80))) for i in range(40)]
    out += [(40, None), (41, ""), (42, base), (43, base), (44, base.replace(base.split()[60], "zzz", 1)), (45, prose(rng, 6000)), (46, " "), (47, "x"), (47, "x"), (None, base), (None, None)]
    return out


def test_token_counts(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    more = texts + [(100, "a  b \n\t▁c<s> é日本" * 5), (101, "y" * 20000)]
    got = token_counts.count_tokens(frame(spark, more, key="k", n_tokens=7)).collect()
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in more)
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(frame(spark, [(1, "a")]).limit(0)).count() == 0


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, texts, monkeypatch):
    items = [(1, " ".join(texts[42][1].split()[10:30])), (2, "X"), (3, None), (4, texts[0][1]), (4, texts[0][1]), (None, "basa"), (5, " ".join(texts[42][1].upper().split()[50:59]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - 7) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    want = []
    for i, t in texts:
        w, hit, found = _words(t), set(), set()
        for p, of in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= of
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    docs = frame(spark, texts, spans=1)
    assert Counter(map(tuple, decontaminate.contamination(docs, bench).collect())) == Counter(want)
    docs = docs.withColumn("items", F.lit("own"))
    full = {p for p in windows if len(p) == 8}
    goes = lambda t, w: w[5] or any(tuple(_words(t)[k : k + 8]) in full for k in range(len(_words(t)) - 7))
    stay = Counter((i, t) for (i, t), w in zip(texts, want, strict=True) if not goes(t, w))
    left = decontaminate.drop_contaminated(docs, bench)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == stay and sum(stay.values()) < len(texts) and (47, "x") in stay
    assert left.columns == docs.columns
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (10,))  # many blocks of items
    assert Counter(map(tuple, decontaminate.contamination(docs, bench).collect())) == Counter(want)
    assert Counter((r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, bench).collect()) == stay
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    ph = decontaminate.Phrases([("1", [b"ba", b"to", b"ri"])])
    docs = frame(spark, [(1, "ba to ri"), (2, "ba x to ri"), (3, "ba x x x x to ri"), (4, "to ba")])
    got = {r.doc_id: (r["items"], r.near) for r in decontaminate.search(decontaminate.build_index(docs, ph), ph, 2).collect()}
    assert got == {1: (["1"], ["1"]), 2: ([], ["1"]), 3: ([], []), 4: ([], [])}


def test_warc(spark):
    rows = [(None, "u", "x"), (1, "u", "x"), (1, "u", "x"), (2, None, None), (3, "v", ""), (5, "a\r\nb", "é" * 70000), (6, "w", "\x1f\x8b\x08 not a member")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for split in (64, 1 << 20):
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, split).collect()), key=repr)
        want = [(None, 1, "revisit", 1), (1, 1, "response", None), (1, 1, "revisit", 1), (2, 0, "revisit", 3), (3, 0, "response", None), (5, 140000, "response", None), (6, 17, "response", None)]
        assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_of_any_header_and_nested_archives(spark, tmp_path):
    rng = random.Random(2)
    digest = lambda raw: hashlib.sha1(raw).hexdigest()
    inner = b"".join(warc.record(900 + k, "nested", x, len(x), digest(x), None) for k, x in ((k, rng.randbytes(900)) for k in range(30)))
    payloads = [b"a", b"before " + inner + b" after", inner, rng.randbytes(50_000), b"", b"\x1f\x8b\x08" * 3000]
    urls = ["u", "v" * 200_000, "w", "".join(chr(rng.randrange(33, 0x3000)) for _ in range(90_000)), "x", "y"]
    folder = tmp_path / "warc"
    folder.mkdir()
    raw = b"".join(warc.record(k, u, x, len(x), digest(x), None) for k, (u, x) in enumerate(zip(urls, payloads, strict=True)))
    raw += warc.record(6, "z", None, 1, digest(b"a"), 0)
    (folder / "a.warc.gz").write_bytes(raw)
    many = b"".join(warc.record(k, "m", str(k).encode(), len(str(k)), digest(str(k).encode()), None) for k in range(100, 160))
    (folder / "b.warc.gz").write_bytes(many)
    manifest = spark.createDataFrame([(f"{folder}/a.warc.gz", len(raw), 7), (f"{folder}/b.warc.gz", len(many), 60)], "path string, n_bytes long, n_records long")
    for split in (512, 4096, 20_000, 1 << 20):
        got = {r.page_id: (r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest, f"file://{folder}", split).collect()}
        want = {k: (u.replace("\x7f", ""), len(x), "response", None) for k, (u, x) in enumerate(zip(urls, payloads, strict=True))}
        want |= {6: ("z", 1, "revisit", 0)} | {k: ("m", 3, "response", None) for k in range(100, 160)}
        assert got == want
    short = manifest.withColumn("n_records", F.col("n_records") + 1)
    with pytest.raises(Exception, match="holds 7 records, not 8|holds 60 records, not 61"):
        warc.read_archives(short, f"file://{folder}").collect()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0]), (0, x[0].tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in sorted(ann.nearest(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    n = np.linalg.norm(x, axis=1)
    hits = 0
    for q in range(0, 1500, 50):
        s = x @ x[q] / (n * n[q])
        best = [int(i) for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:5]
        assert len(got[q]) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in got[q])
        hits += len({i for i, _ in got[q]} & set(best))
    assert hits >= 0.9 * 150 and set(got) == set(range(0, 1500, 50))
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_near_duplicates(spark, texts):
    rng = random.Random(9)
    more = list(texts)
    for g in range(12):  # groups of near copies
        w = prose(rng, 150).split()
        for k in range(6):
            v = list(w)
            for _ in range(2):
                v[rng.randrange(150)] = rng.choice(WORDS)
            more.append((200 + 10 * g + k, " ".join(v)))
    docs = frame(spark, more, key="k", bands=1)
    got = [(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()]
    assert len(got) == len(more)
    cls = dict(got)
    assert {c for i, c in got if i is None} == {40, 42}
    del cls[None]
    sh = {i: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := _words(t)) else {t or ""}) for i, t in more if i is not None}
    for i in sh:
        for j in sh:
            s = len(sh[i] & sh[j]) / len(sh[i] | sh[j])
            if s >= 0.8:
                assert cls[i] == cls[j], (i, j, s)
            elif cls[i] == cls[j]:
                assert i >= 200 and (i - 200) // 10 == (j - 200) // 10 or s > 0.5
    kept = minhash.keep_one(docs)
    assert kept.count() == len(set(cls.values())) and kept.columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_common_text(spark):
    base = [f"w{k}" for k in range(124)]  # 120 shingles
    rows = [(i, " ".join(base)) for i in range(200)] + [(200 + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(400)]
    for i in range(60):
        w = list(base)
        for k in (12, 71, -3):  # 13 of 120 shingles differ
            w[k] = f"new{i}x{k % 124}"
        rows.append((600 + i, " ".join(w)))
    shingled = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows if i == 0 or i >= 600)}
    assert all(len(shingled[0] & s) / len(shingled[0] | s) >= 0.8 for s in shingled.values())
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert {cls[i] for i in shingled} == {0} and all(cls[i] == i for i in range(200, 600))


def test_near_duplicates_among_long_texts(spark, monkeypatch):
    """Groups are compared whole in tiles that are bounded by shingles, too."""
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 5000)
    rng = random.Random(21)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(1500)]
        for i in range(12):
            w = list(base)
            for _ in range(16):  # some pairs are alike, some are just below
                w[rng.randrange(1500)] = f"x{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))
    sh = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    alike = [(i, j) for i in sh for j in sh if i < j and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.8]
    assert alike and all(cls[i] == cls[j] for i, j in alike)
    assert all(cls[i] // 100 == i // 100 for i in cls)


def test_links_grow_fewer_from_round_to_round(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(f"h{k % 3}", f"m{k}") for k in range(300)] + [(f"h{(k + 1) % 3}", f"m{k}") for k in range(300)]  # hubs
    pairs += [(f"p{k:03}", f"p{k + 1:03}") for k in range(200)] + [("x", "x"), ("y", "z"), ("z", "y")]  # a path
    rng.shuffle(pairs)
    sizes = []

    def spy(df, tag):
        out = stored(df, tag)
        if tag == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", spy)
    got = {r.key: r.comp for r in minhash.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(got) == {k for p in pairs for k in p} - {"x"} and set(got.values()) <= set(got)
    assert len({got[k] for k in got if k[0] in "hm"}) == len({got[k] for k in got if k[0] == "p"}) == 1 and len(set(got.values())) == 3
    assert sizes[0] == 801 and sizes[-1] == 0 and sum(sizes) < 2 * 801 and all(a > b for a, b in zip(sizes, sizes[1:]))


def test_links_of_tiles_join_components_only(spark, monkeypatch):
    """Texts that are one component need no links in any tile."""
    monkeypatch.setattr(minhash, "TILE", 4)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(w if j != 5 * i else f"n{i}" for j, w in enumerate(base)) for i in range(30)]
    docs = frame(spark, list(enumerate(texts)))
    vecs, idf = stored(minhash.vectors(docs, docs.select(F.md5("text").alias("key"))), "vectors"), minhash.idf_table(docs)
    for comp, n in ((F.lit("c"), 1), (F.col("key"), 30), (F.substring("key", 1, 1), None)):
        rest = vecs.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("hash"), "key", comp.alias("comp"), F.lit(30).alias("size"), F.lit(1000).alias("shingles"))
        links = {(r.a, r.b) for r in minhash.links_between(rest, vecs, idf).collect()}
        comps = {r.comp for r in rest.collect()}
        assert all(a != b and {a, b} <= comps for a, b in links) and len(comps) == (n or len(comps))
        got = {r.comp for r in minhash.components(spark.createDataFrame(list(links), "a string, b string")).collect()} if links else comps
        assert len(got) == 1


def test_samples_under_counts():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 3000).astype(np.uint64))
    n = rng.integers(1, 4, 3000)
    s = minhash.Sampler(40)
    begins = np.array([0, 500, 1500])
    assert np.array_equal(s.draw_counts(h, n, begins), s.draw(h, np.log(n).astype(np.float32), begins))


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["vile", "scurrilous", "nastyx"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(5, 60)).split()
        y = int(i % 6 == 0)
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if i < 700:
            labels.append((i, 1, y))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows, score="s", term=1), lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert sum(got[i].predicted == (i % 6 == 0) for i in range(700, 900)) >= 190
    assert got[None].predicted == 1 and got[1000].score == got[1001].score < 0.5
    kept = toxicity.drop_toxic(frame(spark, rows, score="s"), lab)
    assert "score" in kept.columns and kept.count() == sum(1 for r in got.values() if r.score < 0.5)
    assert toxicity.toxicity(frame(spark, rows), lab.limit(0)).where("predicted = 1").count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    m = toxicity.Model()
    m.terms = toxicity.Terms([b"t%d" % i for i in range(400)], [])
    m.weight, m.leans = rng.random(400) + 0.1, np.arange(400) % 50 == 0
    share = np.minimum(1, 8 / np.arange(1, 401))
    pick = lambda: np.flatnonzero(rng.random(400) < share)
    rows = [(1000 - i, int(rng.integers(2)), t, rng.integers(1, 4, len(t))) for i in range(700) if len(t := pick())]
    rows += [(2000, 1, *rows[5][2:]), (3, 0, *rows[5][2:])]
    m.index(rows)
    m = pickle.loads(pickle.dumps(m))
    m.nearest(rows[0][2], m.vector(*rows[0][2:]))
    assert (m.frequent >= 0).any() and (m.frequent < 0).any()
    full = np.zeros((len(rows), 400))
    for k, r in enumerate(rows):
        full[k, r[2]] = m.vector(*r[2:])
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for k in range(60):
        at = rows[5][2] if k == 0 else pick()
        w = m.vector(at, np.ones(len(at)) if k else rows[5][3])
        skip = 2000 if k == 1 else None
        sims = full[:, at] @ w
        order = [i for i in np.lexsort((ids, -np.round(sims, 7))) if sims[i] > 0 and ids[i] != skip][: toxicity.K]
        best, got = m.nearest(at, w, skip)
        assert np.allclose(got, sims[order], atol=1e-6)
        assert np.isclose(m.vote(best, got), ((sims[order] * y[order]).sum() + 0.5 * y.mean()) / (sims[order].sum() + 0.5), atol=0.07)
        if k == 0:
            assert set(m.ids[best[:3]]) == {3, rows[5][0], 2000} and m.ids[best[0]] == 3


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 40)) + (" vile" if i % 7 == 0 and i % 5 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.with_scores(docs, model).collect()}
    held = [(i, t) for i, t in rows if i < 300 and zlib.crc32(str(i).encode()) % 5]
    y = {i: int(i % 7 == 0) for i, _ in held}
    word_docs, n = [{0: Counter(), 1: Counter()} for _ in range(2)], Counter(y.values())
    beginnings = lambda w: {x[:h] for x in w for h in (4, 5) if len(x) > h}
    for i, t in held:
        word_docs[0][y[i]].update(set(_words(t)))
        word_docs[1][y[i]].update(beginnings(_words(t)))

    def lean(df, t):
        a, b = df[1][t], df[0][t]
        p, g = (a + b) / len(held), 0
        for k, m in ((a, n[1]), (b, n[0])):
            g += 2 * ((k * math.log(k / (m * p)) if k else 0) + ((m - k) * math.log((m - k) / (m * (1 - p))) if m > k else 0))
        return math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)) if a >= 4 and g >= 18 and a * n[0] > 4 * b * n[1] else 0

    vocabulary = {w for _, t in held for w in _words(t)}

    def vector(t):
        c, out = Counter(_words(t)), {}
        for w, k in c.items():
            if w in vocabulary:
                df = sum(w in _words(x) for _, x in rows)
                out[w] = (1 + math.log(k)) * (math.log((len(rows) + 1) / (df + 1)) + 1) * (0.02 + lean(word_docs[0], w))
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {w: x / norm for w, x in out.items()}

    assert not any(lean(word_docs[1], h) for h in word_docs[1][1])  # so words alone are terms here
    vectors = {i: vector(t) for i, t in held if _words(t)}
    tried = 0
    for i, t in rows[::9]:
        if not (v := vector(t) if _words(t) else {}):
            assert math.isclose(got[i].score, model.rate)
            continue
        sims = sorted(((sum(x * o.get(w, 0) for w, x in v.items()), -j) for j, o in vectors.items()), reverse=True)
        sims = [s for s in sims if s[0] > 0]
        top = sims[:15]
        if len(sims) > 15 and abs(sims[14][0] - sims[15][0]) < 1e-6:
            continue  # a tie at the edge
        vote = (sum(s * y[-j] for s, j in top) + 0.5 * np.mean([y[j] for j in vectors])) / (sum(s for s, _ in top) + 0.5)
        assert math.isclose(got[i].score, model.calibrated(vote), abs_tol=1e-3)
        tried += 1
    assert tried > 25 and len({round(r.score, 6) for r in got.values()}) > 20


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    line = prose(rng, 30)
    more = texts + [(300 + i, prose(rng, 20) + "\n" + line + "\n" + prose(rng, 20)) for i in range(8)] + [(400, (line + "\n") * 6), (401, "z" * 700), (402, "ab" * 200 + "é" * 90)]
    more = [(i, t) for i, t in more if i is not None and not (i == 47)] + [(47, "x")]
    seen, want = set(), {}
    for i, t in sorted(more, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(raw[a : a + 100])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want[i] = (len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0, hashlib.sha256(left).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, more, row=1)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    both = suffix_dedup.remove_repeats(frame(spark, [(1, line), (1, line), (None, None)])).collect()
    assert sorted(r.n_removed for r in both) == [0, 0, len(line)]
    assert suffix_dedup.remove_repeats(frame(spark, more).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    t = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 80))] + [0], np.int16)
    sa = suffix_dedup.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_language_model(spark, texts):
    got = lm_scoring.score_texts(frame(spark, texts, key="k")).collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 6)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(frame(spark, texts).limit(0)).count() == 0


def test_language_model_learns_from_every_text(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(lm_scoring, "SHARD", 100)
    rng = random.Random(8)
    rows = [(i, prose(rng, 30)) for i in range(300)] + [(None, "zebra zebra"), (None, "zebra zebra")]
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    want = Counter()
    for k, t in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            ids = [-1, *(i for w in t.split() for i in sp.encode(w)), -1]
            want.update(zip(ids, ids[1:]))
    learn = lambda df: lm_scoring.learn(*lm_scoring.gathered(df, token_counts.model_path()))
    model, number, share = learn(frame(spark, rows))
    to = lambda i: 0 if i < 0 else int(number[i])
    got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in model.pairs), strict=True)}
    assert got == {(to(a), to(b)): n for (a, b), n in want.items()} and not share[[i for p in want for i in p if i >= 0]].any()
    again = learn(frame(spark, rows, parts=5))[0]
    other = learn(frame(spark, [(i, t.replace("basa", "nezu") if i == 299 else t) for i, t in rows]))[0]
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-6) for k in model.p) and np.isfinite(model.p["u"]).all()
    assert not np.allclose(model.p["u"], other.p["u"], atol=1e-6)


def test_language_model_trains_on_every_window(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "START_BYTES", 0)
    monkeypatch.setattr(lm_scoring, "SHARD", 50)
    rng, seen = random.Random(12), []
    rows = [(i, prose(rng, rng.randint(1, 300))) for i in range(80)]
    sub = lm_scoring.Subwords(token_counts.model_path())
    size = lambda t: sum(len(x) >> 1 for _, x in sub.of([*lm_scoring.words_of(t.encode()), lm_scoring.END]))
    want = sum(-(-size(t) // lm_scoring.STRIDE) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)

    def spy(df, tag):
        out = stored(df, tag)
        if tag == "lm-weights":
            seen.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(lm_scoring, "stored", spy)
    lm_scoring.learn(*lm_scoring.gathered(frame(spark, rows), token_counts.model_path()))
    assert seen[-1] == want > 500


def test_language_model_beats_its_base_on_held_out_texts(spark):
    for sf, more in (("0.01", 0.01), ("0.1", 0.15)):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        r = lm_scoring.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert r[0] / r[2] > r[1] / r[2] + more


def test_scores_against_a_plain_model(spark, texts):
    """Mixture and attention written out token by token for a few texts."""
    docs = frame(spark, texts[:44])
    model, number, share = lm_scoring.learn(*lm_scoring.gathered(docs, token_counts.model_path()))
    model._lay_out()
    sub = lm_scoring.Subwords(token_counts.model_path())
    low = lambda t: lm_scoring.words_of((t or "").encode()) + [b"\n"]
    c = Counter(w for i, t in texts[:44] if zlib.crc32(str(i).encode()) % 7 != 2 for w in low(t))
    n, p, ctx = sum(c.values()), model.p, lm_scoring.CONTEXT
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(docs).collect()}
    for i, t in texts[:6] + texts[40:43]:
        total, ids, owner = 0.0, [], []
        for k, w in enumerate(low(t)):
            x = number[np.frombuffer(sub.of([w])[0][1], np.uint16)]
            ids += x.tolist()
            owner += [k] * len(x)
        logs = np.zeros(len(low(t)))
        for at, y in enumerate(ids):
            first = at // lm_scoring.STRIDE * lm_scoring.STRIDE - ctx
            x = [ids[j - 1] if j >= 1 else 0 for j in range(first, at + 1)]
            h = p["e"][x] + p["pos"][: len(x)]
            a = (h[-1] @ p["q"]) @ (h @ p["k"]).T / math.sqrt(lm_scoring.WIDTH)
            a = np.exp(a - a.max())
            z = np.tanh((a / a.sum()) @ (h @ p["v"]) + p["last"][x[-1]])
            k, m = divmod(y, lm_scoring.MEMBERS)
            for logits, place in ((model.of_class[x[-1]] + z @ p["u"], k), (model.in_class[x[-1], k] + z @ p["m"][k], m)):
                logs[owner[at]] += logits[place] - np.log(np.exp(logits).sum())
        for w, x in zip(low(t), logs, strict=True):
            total += math.log10(lm_scoring.MIX * c[w] / n + (1 - lm_scoring.MIX) * math.exp(x))
        assert math.isclose(total, got[i], rel_tol=1e-3, abs_tol=1e-2), i


def test_words_and_subwords_by_the_block(monkeypatch):
    """Each different word of a block is cut once, also where kept words make room; words never join across texts."""
    monkeypatch.setattr(lm_scoring, "CACHE", 5)
    rng = random.Random(6)
    sub, plain, asked = lm_scoring.Subwords(token_counts.model_path()), lm_scoring.Subwords(token_counts.model_path()), []
    cut = sub._cut
    monkeypatch.setattr(sub, "_cut", lambda words: asked.extend(words) or cut(words))
    pieces = ["Ab", "c", "é😀", " ", "\n", "\t ", "zebra", "\x00", "\x1c", "", "A"]
    for texts in (["", ""], ["x", "y z", "", " ", "Q"], *(["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(30)] for _ in range(6))):
        raw = [t.encode() for t in texts]
        tokens, place, n = lm_scoring.tokens_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [[*lm_scoring.words_of(t), lm_scoring.END] for t in raw]
        assert n.tolist() == [len(w) for w in want] and [tokens[i] for i in place] == [w for t in want for w in t]
        before = len(asked)
        keys, parts, ids, rank = sub.block(tokens, place)
        assert len(set(tokens)) == len(tokens) and len(set(asked[before:])) == len(asked) - before
        at = np.cumsum(parts)
        got = [(int(keys[r]), ids[at[r] - parts[r] : at[r]].tobytes()) for r in rank]
        assert got == [plain.of([w])[0] for t in want for w in t] and (keys[1:] > keys[:-1]).all()


def test_windows_score_each_token_once():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, lm_scoring.VOCABULARY, (2, 500))
    m = lm_scoring.Attention((pairs[0], pairs[1], np.ones(500)))
    lens = np.array([1, 32, 33, 100])
    _, targets = lm_scoring.windows(lens)
    assert sorted(targets[targets >= 0].tolist()) == list(range(lens.sum()))
    stream = rng.integers(0, lm_scoring.VOCABULARY, lens.sum())
    m.p["u"] += rng.normal(size=m.p["u"].shape).astype(np.float32)
    m.p["m"] += rng.normal(size=m.p["m"].shape).astype(np.float32)
    whole = m.score(stream, lens)
    assert np.allclose(whole[66:], m.score(stream[66:], np.array([100])), atol=1e-3)
    x = np.zeros((1, lm_scoring.WINDOW), np.int64)
    p = [np.exp(m.log_probability(x, np.full((1, lm_scoring.STRIDE), k))) for k in range(lm_scoring.VOCABULARY)]
    assert np.allclose(sum(p), 1, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, lm_scoring.VOCABULARY, (2, 500))
    m = lm_scoring.Attention((pairs[0], pairs[1], np.ones(500)))
    m.p = {k: (v + rng.normal(size=v.shape) * 0.2).astype(np.float64) for k, v in m.p.items()}
    x = rng.integers(0, 40, (3, lm_scoring.WINDOW))
    y = np.where(rng.random((3, lm_scoring.STRIDE)) < 0.1, -1, rng.integers(0, 90, (3, lm_scoring.STRIDE)))
    loss = lambda: -m.log_probability(x, y).sum() / (y >= 0).sum()
    g = m.gradients(x, y)
    for k, v in m.p.items():
        for at in [tuple(a) for a in np.argwhere(np.abs(g[k]) > np.abs(g[k]).max() / 2)[:3]]:
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert np.isclose((up - down) / 2e-3, g[k][at], rtol=0.05, atol=1e-5), (k, at)


def _base(t):
    t, out = t or "", []
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(3)
    parts = ["a", "b1", "@", ".", "-", "+", "4", "42", "255", "256", " ", "  ", "(", ")", "1.2.3.4", "4041894974608795", "é", "x@y.com", "_d@e.f", "+49 30 1234567", "\n", "😀", "call (555) 123-4567", "mail me at dot com"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(400)] + [(None, None), (-2, "1" * 9000), (-3, "a" * 9000 + "@"), (-6, "a@b.c " * 90), (7, "x@y.com"), (7, "x@y.com")]
    docs = frame(spark, rows, spans=1, row=2)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(docs).collect())
    digest = lambda b: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
    want = Counter((i, *(sum(x[0] == k for x in _base(t)) for k in range(4)), digest(_base(t))) for i, t in rows)
    assert got == want
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    clean = masked.collect()
    assert len(clean) == len(rows) and all(not _base(r.text) or "[" in r.text for r in clean)
    assert {r.text for r in clean if r.doc_id == 7 and r.text.startswith("[")} == {"[EMAIL]"}
    assert pii.personal_data(docs.limit(0)).count() == 0


def _masked(t, spans):
    out, at, last = "", 0, -1
    for a, z, k in sorted(spans):
        if a >= last:
            out += t[at if last < 0 else last : a] + f"[{pii.KINDS[k].upper()}]"
            last = z
        last = max(last, z)
    return out + t[max(last, 0) :]


def test_masked_texts(spark):
    rng = random.Random(4)
    parts = ["é😀 ", "a@b.co ", "call (555) 123-4567 ", "+49 30 1234567", "1.2.3.4", "4041894974608795", "word " * 300, "me at x dot com "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(60)] + [(100, "zé " * 40000 + "a@b.co" + "y " * 40000)]
    docs = frame(spark, rows, row=1, key="k").withColumn("base", F.lit(1)).withColumn("ends", F.lit(2))
    found = pii.candidates(docs, "doc_id", "text")
    spans = {r.doc_id: [(x.s, x.e, x.k) for x in r.spans] for r in pii.detect(found, pii.fit(found)).collect()}
    texts = dict(rows)
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {i: _masked(t, spans[i]) for i, t in texts.items()}
    base = {i: {(a, z, k) for k, a, z in _base(t)} for i, t in texts.items()}
    for i, s in spans.items():  # further spans: from the wide patterns or the checks' rejects, clear of every base span
        assert base[i] <= set(s)
        assert all(z <= s_ or e <= a for s_, e, _ in set(s) - base[i] for a, z, _ in base[i])


def test_masking_runs_the_patterns_once(spark, monkeypatch):
    calls, found = [], pii.with_base
    monkeypatch.setattr(pii, "with_base", lambda docs: calls.append(1) or found(docs))
    docs = frame(spark, [(1, "mail a@b.com"), (2, None), (3, ""), (4, "x")], row=1).withColumn("none", F.lit(True)).withColumn("C1", F.lit("z"))
    masked = pii.redact(docs)
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "regexp_extract_all" not in plan
    assert masked.columns == docs.columns and masked.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = {(i, t, n, "en", 1, True, "z") for i, t, n in ((1, "mail [EMAIL]", 12), (2, None, None), (3, "", 0), (4, "x", 1))}
    assert {tuple(r) for r in masked.select("doc_id", "text", "n_chars", "lang", "row", "none", "C1").collect()} == want


def test_personal_data_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 20_000, 125_000):  # the first also warms up
        docs = frame(spark, [(1, "ab@c.de " * n)], parts=1)
        began = time.time()
        found = pii.with_candidates(pii.with_base(docs))
        got = pii.detect(found, {"email|prior": 0.0}).select(F.size("spans").alias("n")).first()
        took.append(time.time() - began)
        assert got.n == n
    assert took[2] < 12 * took[1] + 5
    masked = pii.redact(frame(spark, [(1, "ab@c.de é" * 50_000)], parts=1)).first().text
    assert masked == "[EMAIL] é" * 50_000


def test_every_wide_address_passes_the_shortcut(spark):
    ways = [f"jane{at}example{dot}com" for at in (" at ", "[at]", "(at)", " [at] ", " (at) ") for dot in (".", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", " (dot)")]
    rows = pii.with_base(frame(spark, enumerate(ways))).selectExpr("doc_id", "wide_email.m as m").collect()
    assert {r.doc_id: r.m for r in rows} == {i: [w] for i, w in enumerate(ways)}


@pytest.mark.parametrize("n", [0, 1, 7, 800])
def test_packing(n):
    rng = random.Random(n)
    sizes = [min(8192, int(rng.lognormvariate(6, 1.2))) for _ in range(n)] + [0] * (n // 10)
    where, offset, final = packing.pack(sizes)
    bins = {}
    for i, b in enumerate(where):
        bins.setdefault(b, []).append((offset[i], sizes[i]))
    assert len(bins) == len(final)
    for b, got in bins.items():
        at = 0
        for o, s in sorted(got):
            assert s == 0 or o == at
            at += s
        assert final[b] == min(c for c in packing.LENGTHS if c >= at)
    if n == 800:
        assert sum(sizes) / sum(final) > 0.98


def test_packing_rows(spark, texts):
    docs = frame(spark, texts + [(900, prose(random.Random(1), 9000))])
    rows = packing.pack_texts(docs).collect()
    by = Counter()
    for r in rows:
        by[r.doc_id] += r.n_tokens
    want = Counter()
    for r in token_counts.count_tokens(docs).collect():
        want[r.doc_id] += r.n_tokens
    assert by == want and all(r.bin_offset + r.n_tokens <= r.bin_length for r in rows)
    assert packing.pack_texts(docs.limit(0)).count() == 0


def test_packed_sequences(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    rows = [(i, t) for i, t in texts if i is not None and i != 47] + [(900, prose(random.Random(1), 9000))]
    got = {}
    for r in packing.pack_sequences(frame(spark, rows, n_tokens=1)).collect():
        assert len(r.tokens) == r.n_tokens <= r.bin_length and r.bin_length == min(c for c in packing.LENGTHS if c >= r.n_tokens)
        for doc, a, z in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], strict=True):
            got.setdefault(doc, []).append(r.tokens[a:z])
    for i, t in rows:
        pieces, want = got.get(i, []), sp.encode(t or "")
        assert sorted(map(tuple, pieces)) == sorted(tuple(want[a : a + 8192]) for a in range(0, len(want), 8192))
    assert packing.pack_sequences(frame(spark, rows).limit(0)).count() == 0


def test_keep_one_and_clashing_names(spark):
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [(1, base), (2, base), (3, prose(rng, 60)), (None, base), (3, None), (3, None)]
    docs = frame(spark, rows, key="k")
    for c in ("text_key", "kept_id", "kept_key", "__id", "__key", "comp", "class_id"):
        docs = docs.withColumn(c, F.lit(5))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, base), (3, rows[2][1]), (3, None)])


def test_pipeline(spark, tmp_path):
    """Planted toxic, copied, contaminated and personal rows: each stage takes its own and leaves the others."""
    import corpus_pipeline

    rng = random.Random(12)
    plain = lambda i: " ".join(f"w{rng.randrange(400)}" for _ in range(60 + i % 7))
    rows, labels = {i: plain(i) for i in range(500)}, {}
    for i in range(300):
        labels[i] = int(i % 6 == 0)
        if labels[i]:
            rows[i] += " vile scurrilous"
    toxic = {i for i in labels if labels[i]} | {400, 401}
    rows[400] += " vile"
    rows[401] = "scurrilous " + rows[401]
    item = " ".join(f"q{k}" for k in range(30))
    short = "one lone item"
    rows[410], rows[411], rows[412] = rows[410] + " " + item, rows[411] + " " + " ".join(item.split()[3:14]), rows[412] + " " + short
    contaminated = {410, 411}
    copies = {420: 421, 430: 431, 440: 441}  # an exact copy, a near one, one of a text without words
    rows[421], rows[431] = rows[420], rows[430].replace(rows[430].split()[30], "other", 1)
    rows[440], rows[441] = "?!", "?!"
    rows[450], rows[451] = "write to jane@example.com or +49 30 1234567 now " + rows[450], rows[451] + " at 10.1.2.3"
    table = [(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(600, None, "en", "s", 0), (None, rows[460], "en", "s", 1)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(table, SCHEMA).withColumn("score", F.lit("own")).withColumn("items", F.lit(1))
    docs.repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, short), (3, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    got, left = spark.read.parquet(f"{sf}/documents.parquet"), set(rows) | {600, None}
    names, gone = got.columns, [toxic, set(copies.values()) | {None}, contaminated, set()]
    for (name, stage), less in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        got = stored(stage(spark, got, sf), name)
        left -= less
        assert got.columns == names and ids(got) == left and got.count() == len(left), name
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts[450][0].startswith("write to [EMAIL] or [PHONE] now w") and texts[451][0].endswith(" at [IP]")
    assert texts[450][1] == len(texts[450][0]) and texts[600] == (None, None if texts[600][1] is None else 0)
    assert all(texts[i][0] == rows[i] for i in left if i not in (450, 451, 600))
    packed = corpus_pipeline.STAGES[-1][1](spark, got, sf).collect()
    assert {r.doc_id for r in packed} == left
    size = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(got).collect()}
    assert {i: sum(r.n_tokens for r in packed if r.doc_id == i) for i in left} == size
    run = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in run) == Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _stored_files(spark):
    root = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    return {str(p) for d in root.glob("parsimony-*") for p in d.iterdir()}


@pytest.mark.parametrize("run", [minhash.near_duplicates, suffix_dedup.remove_repeats, lm_scoring.score_texts], ids=["op6_minhash", "op8_suffix_dedup", "op10_lm_scoring"])
def test_stored_tables_start_no_process_of_hadoop(spark, texts, monkeypatch, run):
    """Hadoop's local file system runs chmod for each file it makes, and leaves a checksum file beside it."""
    monkeypatch.setattr(common, "drop_folder", lambda *a: None)
    before = _stored_files(spark)
    run(frame(spark, texts)).count()
    made = _stored_files(spark) - before
    assert made and all(re.search(r"/part-\d{5}-\w+\.parquet$", p) for p in made)


def test_written_tables(spark):
    """Rows come back as they were, in small row groups; what a failed attempt leaves is not read."""
    from pyarrow import parquet as pq

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else b"x" * 900_000, [i, None], (i, str(i))) for i in range(40)] + [(None, None, None, None)], "a int, b binary, c array<long>, d struct<n: long, s: string>")
    before = _stored_files(spark)
    got = common.written(rows.repartition(3), "any")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect())) and got.dtypes == rows.dtypes
    files = sorted(_stored_files(spark) - before)
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert len(files) == 3 and all(m.row_group(i).column(1).total_uncompressed_size < 2 * (common.BATCH_BYTES + common.GROUP_BYTES) for m in groups for i in range(m.num_row_groups)) and sum(m.num_row_groups for m in groups) > 3
    folder = Path(files[0]).parent
    (folder / ".00000-dead").write_bytes(b"half a file")
    assert spark.read.parquet(str(folder)).count() == 41
    assert common.written(rows.limit(0), "none").count() == 0

    def twice(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * (x or 0) for x in b.column(0).to_pylist()], pa.int64())], names=["z"])

    assert sorted(r.z for r in common.written(rows, "run", twice, "z long").collect()) == sorted([0, *(2 * i for i in range(40))])


def test_training_windows_by_definition():
    """Each window against its text, written out."""
    rng = np.random.default_rng(3)
    lens = np.array([1, 32, 33, 31, 64, 200])
    stream = rng.integers(0, 32000, lens.sum()).astype(np.uint16)
    want, at = [], 0
    for n in lens.tolist():
        text = [32000] * (lm_scoring.CONTEXT + 1) + stream[at : at + n].tolist() + [65535] * lm_scoring.STRIDE
        want += [text[k : k + lm_scoring.WINDOW + 1] for k in range(0, n, lm_scoring.STRIDE)]
        at += n
    got = lm_scoring.training_windows(stream, lens, 32000)
    assert got.dtype == np.uint16 and got.tolist() == want
    assert lm_scoring.training_windows(stream[:0], lens[:0], 32000).shape == (0, lm_scoring.WINDOW + 1)


def test_shuffle_files_of_written_tables_are_removed(spark, monkeypatch):
    """They lie on the disk until the driver collects its garbage otherwise; the setting holds for this query only."""
    tidy, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: [seen.append(spark.conf.get(tidy)), collect(df)][1])
    got = common.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    assert seen == ["true"] and spark.conf.get(tidy, "false") == "false" and got.count() == 7


def test_known_words_cost_no_call_each():
    """Finding of r02: every different word of every block was sliced, looked up and hashed in Python, over the CPU budget."""
    rng = random.Random(2)
    words = list({"".join(rng.choices("abcdefgh\x00é", k=rng.randint(1, 90))) for _ in range(3000)})
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    sub, calls = lm_scoring.Subwords(token_counts.model_path()), []
    cut = lambda: sub.block(*lm_scoring.tokens_of(raw, np.array([0, len(raw)]))[:2])
    first = cut()
    assert len(first[0]) == len(words) + 1 and sub.of([w.encode() for w in words]) == [(int(first[0][r]), i) for r, i in zip(first[3][:-1], _each(first), strict=True)]
    sys.setprofile(lambda *a: calls.append(a[1]))
    try:
        again = cut()
    finally:
        sys.setprofile(None)
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True)) and len(calls) < len(words)


def _each(block):
    at = np.cumsum(block[1])
    return [block[2][at[r] - block[1][r] : at[r]].tobytes() for r in block[3][:-1]]


def test_hashes_go_by_bytes_alone():
    """Wherever a word lies in the buffer, also with zero bytes and across the size from which xxhash takes over."""
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in range(1, 80) for _ in range(6)]
    pad = [bytes(int(k)) for k in rng.integers(0, 9, len(words))]
    size = np.array([len(w) for w in words])
    at = np.cumsum([len(p) + len(w) for p, w in zip(pad, words, strict=True)]) - size
    low = np.frombuffer(b"".join(p + w for p, w in zip(pad, words, strict=True)) + bytes(16), np.uint8)
    got = lm_scoring.hashes(low, at, size).tolist()
    by = {}
    assert all(by.setdefault(w, k) == k for w, k in zip(words, got, strict=True)) and len(set(got)) == len(by)
    assert [k for k, _ in lm_scoring.Subwords(token_counts.model_path()).of(words)] == got


def test_shards_share_tables():
    m = lm_scoring.Attention((np.array([0, 5]), np.array([5, 0]), np.ones(2)))
    one, two = m.copy(), m.copy()
    assert one.in_class is two.in_class and one.of_class is m.of_class
    one.p["u"] += 1
    assert not m.p["u"].any() and not two.p["u"].any()
