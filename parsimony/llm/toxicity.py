"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled training rows (SAMPLE rows, those with the smallest hash of doc_id; held-out rows never) is
the example set. Every word of these texts is a term; so are those beginnings of 4 and 5 bytes of longer words that lean
toxic. A term weighs (1 + log of its count) x idf x (FLOOR + lean). Idf is counted over all documents. Lean is the
term's log ratio of toxic to other examples where that is far beyond chance (log-likelihood ratio), else 0: one vile
word among hundreds would not move a plain cosine of whole texts.

The examples lie in an inverted index, in blocks of similar ones. Lists of rare terms are short and added up as they
are; lists of frequent terms are cut into blocks, stored in full, with the largest weight of each block. A document's K
nearest examples are found exactly: what the rare terms give and the block maxima bound every block's best cosine, and
blocks are finished from the highest bound down until none reaches the K-th best. Cosine-weighted votes become a score
by monotone calibration on the examples, each scored without itself; the nearest examples' ids are the evidence.

Null and empty texts, and others without any term, get the rate of toxic examples without a lean term. Repeated rows score
alike. Label rows with null toxic or doc_id are left out; of repeated labels the largest counts, of repeated documents
with a label the least text. Without labels of both kinds every score is the rate of toxic labels (0 without any).
Labels, lang, source and doc_id are no inputs of a score. Texts of any length are read whole; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, column, free_name, give_back, stored, text_buffer
from .decontaminate import _TABLE

#: Labelled rows from which terms, examples and calibration are learned.
SAMPLE = 6_000
BLOCK, K = 64, 15
#: Text bytes that a worker takes apart at once.
BLOCK_BYTES = 1 << 20
#: A leaning term needs so many toxic examples, such a log-likelihood ratio, and so many times the rate of other examples.
LEAST_DF, LEAST_G2, LEAST_RATIO = 4, 18.0, 4.0
#: What the share of toxic examples weighs in a vote, as a cosine.
DRAW = 0.5
#: What a term weighs that does not lean.
FLOOR = 0.02
#: A term that more than this share of the examples holds is frequent.
FREQUENT = 1 / 24
_HEADS = (4, 5)


def held_out(doc_id: str = "doc_id", of: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == rest, F.lit(False))


class Terms:
    """Numbers of words, and behind them of word beginnings. Words travel compressed."""

    def __init__(self, words: list[bytes], heads: list[bytes]):
        self.words = {w: k for k, w in enumerate(words)}
        self.heads = {h: len(words) + k for k, h in enumerate(heads)}
        self.size = len(words) + len(heads)

    def __getstate__(self) -> tuple[bytes, list[bytes]]:
        return zlib.compress(b" ".join(self.words), 6), list(self.heads)

    def __setstate__(self, state: tuple[bytes, list[bytes]]) -> None:
        self.__init__(zlib.decompress(state[0]).split(), state[1])

    def of(self, word: bytes) -> list[int]:
        """Terms that a word stands for."""
        at = [self.words[word]] if word in self.words else []
        return at + [self.heads[word[:h]] for h in _HEADS if len(word) > h and word[:h] in self.heads]

    def begun(self, words: Iterable[bytes]) -> list[tuple[bytes, int]]:
        """The words that begin as a term does, with that term; most texts have none, which is seen from all beginnings at once."""
        out = []
        for h in _HEADS:
            there = self.heads.keys() & {w[:h] for w in words}
            if there:
                out += [(w, self.heads[w[:h]]) for w in words if len(w) > h and w[:h] in there]
        return out

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text and how often each stands in it."""
        c = Counter(words)
        get = self.words.get
        at, n = np.array([get(w, -1) for w in c], np.int64), np.fromiter(c.values(), np.int64, len(c))
        at, n = at[at >= 0], n[at >= 0]
        if more := self.begun(c):
            sums: Counter = Counter()
            for w, t in more:
                sums[t] += c[w]
            at, n = np.append(at, list(sums)), np.append(n, list(sums.values()))
        return at, n

    def present(self, words: list[bytes]) -> list[int]:
        """The terms of a text, once each."""
        distinct = set(words)
        get = self.words.get
        return [t for w in distinct if (t := get(w)) is not None] + list({t for _, t in self.begun(distinct)})


def _texts(b: pa.RecordBatch) -> Iterator[list[bytes]]:
    raw, off = text_buffer(column(b, "text"))
    raw = raw.tobytes().translate(_TABLE)
    for i in range(b.num_rows):
        yield raw[off[i] : off[i + 1]].split()


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and text of at most SAMPLE training rows, stored."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return stored(rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity-sample")


def sample_words(rows: DataFrame) -> tuple[dict[bytes, int], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Numbers of the words of the sampled rows, and by doc_id each row's doc_id, label, distinct words (by number) and their counts; bounded by SAMPLE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            found = [Counter(w) for w in _texts(b)]
            words = pa.array([b" ".join(c) for c in found], pa.binary())
            counts = pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "toxic"), words, counts], names=["doc_id", "toxic", "words", "counts"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, words binary, counts binary").orderBy("doc_id").toLocalIterator()
    at: dict[bytes, int] = {}
    held = []
    for r in got:
        words = bytes(r.words).split()
        held.append((r.doc_id, int(r.toxic > 0), np.fromiter((at.setdefault(w, len(at)) for w in words), np.int32, len(words)), np.frombuffer(bytes(r.counts), np.int32)))
    return at, held


def _lean(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log ratio of the rates of terms in toxic and other examples, where it is large and beyond chance; else 0."""
    a, b, whole = toxic.astype(np.float64), other.astype(np.float64), (toxic + other) / (n_toxic + n_other)
    term = lambda k, p: k * np.log(np.where(k > 0, k, 1) / np.where(k > 0, p, 1))
    part = lambda k, n: term(k, n * whole) + term(n - k, n * (1 - whole))
    g2 = 2 * (part(a, n_toxic) + part(b, n_other))
    strong = (a >= LEAST_DF) & (g2 >= LEAST_G2) & (a * n_other > LEAST_RATIO * b * n_toxic)
    return np.where(strong, np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1)), 0)


def _by_label(numbers: list[np.ndarray], y: np.ndarray, size: int) -> list[np.ndarray]:
    """In how many examples of each label each number stands."""
    return [np.bincount(np.concatenate([x for x, t in zip(numbers, y.tolist(), strict=True) if t == label] or [np.empty(0, np.int64)]), minlength=size) for label in (0, 1)]


def learn_terms(at: dict[bytes, int], held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[Terms, np.ndarray]:
    """Every word of the examples and the leaning beginnings of words, and the lean of each term."""
    y = np.array([h[1] for h in held])
    words = [h[2] for h in held]
    lean = _lean(*reversed(_by_label(words, y, len(at))), int(y.sum()), int(len(y) - y.sum()))
    heads: dict[bytes, int] = {}
    of = [[heads.setdefault(w[:h], len(heads)) if len(w) > h else -1 for w in at] for h in _HEADS]
    of = np.array(of, np.int32).reshape(len(_HEADS), -1)
    begun = [np.setdiff1d(of[:, w], [-1]) for w in words]
    more = _lean(*reversed(_by_label(begun, y, len(heads))), int(y.sum()), int(len(y) - y.sum()))
    return Terms(list(at), [h for h, k in heads.items() if more[k] > 0]), np.append(lean, more[more > 0])


def document_counts(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term, over the whole corpus: one compressed table a task, added up on the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, own = np.zeros(shared.value.size, np.uint32), 0, shared.value
        for b in blocks(batches, BLOCK_BYTES):
            n += b.num_rows
            found = [t for words in _texts(b) for t in own.present(words)]
            df += np.bincount(np.array(found, np.int64), minlength=own.size).astype(np.uint32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(n).integers(64)], pa.int32()), pa.array([n], pa.int64()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], names=["part", "n", "df"])

    def added(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shared.value.size, np.uint64), 0
        for b in group:
            for k, x in zip(column(b, "n").to_pylist(), column(b, "df"), strict=True):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    tables = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "part int, n long, df binary")
    total, n = np.zeros(terms.size, np.float64), 0
    for r in tables.groupBy("part").applyInArrow(added, "n long, df binary").toLocalIterator():
        total += np.frombuffer(bytes(r.df), np.uint64)
        n += r.n
    shared.destroy()
    return n, total


class Model:
    """Terms and their weights, the block-max index of examples, and calibration.

    What travels is each example's terms and counts, compressed; the lists are laid out where they are used.
    """

    def __init__(self):
        self.terms = Terms([], [])
        self.weight = np.empty(0)
        self.leans = np.empty(0, bool)
        self.rate = 0.0
        self.steps: tuple[list[float], list[float]] = ([], [])
        self.ids, self.y, self.packed, self.built = np.empty(0, np.int64), np.empty(0), b"", False

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "weight", "leans", "rate", "steps", "ids", "y", "packed")} | {"built": False}

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weight[at]
        return w / np.sqrt((w * w).sum())

    def index(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """examples: doc_id, label, terms (ascending) and counts, none of them without terms. Similar ones come together: those with the same heaviest leaning term, and others by their frequent terms."""
        often = np.bincount(np.concatenate([e[2] for e in examples]), minlength=self.terms.size)
        often = np.argsort(-often, kind="stable")[:512]
        place = np.full(self.terms.size, -1)
        place[often] = np.arange(len(often))
        full, heaviest = np.zeros((len(examples), len(often)), np.float32), np.full(len(examples), -1)
        for i, (_, _, at, n) in enumerate(examples):
            w, to = self.vector(at, n), place[at]
            full[i, to[to >= 0]] = w[to >= 0]
            if self.leans[at].any():
                heaviest[i] = at[np.argmax(w * self.leans[at])]
        examples = [examples[i] for i in np.lexsort((np.arange(len(examples)), _clusters(full), heaviest))]
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.y = np.array([e[1] for e in examples], np.float64)
        steps = np.concatenate([np.diff(e[2], prepend=0) for e in examples])
        lens, counts = np.array([len(e[2]) for e in examples]), np.concatenate([e[3] for e in examples])
        self.packed = tuple(zlib.compress(x.astype(np.int32).tobytes(), 6) for x in (lens, steps, counts))
        self.built = False

    def _lay_out(self) -> None:
        lens, steps, counts = (np.frombuffer(zlib.decompress(x), np.int32) for x in self.packed)
        n, first = len(lens), np.cumsum(lens, dtype=np.int64) - lens
        term = np.cumsum(steps, dtype=np.int64)
        term = (term - np.repeat(term[first] - steps[first], lens)).astype(np.int32)
        w = (1 + np.log(counts.astype(np.float32))) * self.weight[term]
        del steps, counts
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, first, dtype=np.float64)).astype(np.float32), lens)
        who = np.repeat(np.arange(n, dtype=np.int32), lens)
        frequent = np.flatnonzero(np.bincount(term, minlength=self.terms.size) > max(n * FREQUENT, BLOCK))
        self.frequent = np.full(self.terms.size, -1, np.int32)  # a frequent term's row
        self.frequent[frequent] = np.arange(len(frequent))
        n_blocks = -(-n // BLOCK)
        self.tiles = np.zeros((n_blocks, len(frequent), BLOCK), np.float32)  # block, term, example
        often = np.flatnonzero(self.frequent[term] >= 0)
        self.tiles[who[often] // BLOCK, self.frequent[term[often]], who[often] % BLOCK] = w[often]
        self.most = np.ascontiguousarray(self.tiles.max(2).T)  # term, block
        del often
        rare = np.flatnonzero(self.frequent[term] < 0).astype(np.int32)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.holders, self.held = who[rare].astype(np.int64), w[rare].astype(np.float32)
        self.begins = np.searchsorted(term[rare], np.arange(self.terms.size + 1)).astype(np.int64)
        self.built = True

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples (not that of doc_id skip) and their cosines, nearest first; ties to the smaller doc_id."""
        if not self.built:
            self._lay_out()
        n_blocks = len(self.tiles)
        lo = self.begins[at]
        lens = self.begins[at + 1] - lo
        spots = np.repeat(lo - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        got = np.bincount(self.holders[spots], self.held[spots] * np.repeat(w, lens), minlength=n_blocks * BLOCK).reshape(n_blocks, BLOCK)
        often = self.frequent[at]
        often, heavy = often[often >= 0], w[often >= 0].astype(np.float32)
        bounds = got.max(1) + heavy @ self.most[often]
        best, sims = np.empty(0, np.int64), np.empty(0)
        order = np.argsort(-bounds, kind="stable")
        for a in range(0, n_blocks, 6):
            some = order[a : a + 6]
            if bounds[some[0]] <= 0 or (len(best) == K and bounds[some[0]] < sims[-1] - 1e-6):
                break
            found = got[some] + (heavy @ self.tiles[some[:, None], often] if len(often) else 0)
            rows = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = found.ravel()
            keep = np.flatnonzero(found > (sims[-1] - 1e-12 if len(best) == K else 0))
            keep = keep[rows[keep] < len(self.ids)]
            if skip is not None:
                keep = keep[self.ids[rows[keep]] != skip]
            best, sims = np.concatenate([best, rows[keep]]), np.concatenate([sims, found[keep]])
            top = np.lexsort((self.ids[best], -sims))[:K]
            best, sims = best[top], sims[top]
        return best, sims

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic ones among the nearest by cosine, drawn towards the share among all the farther they are."""
        return float(((sims * self.y[best]).sum() + DRAW * self.y.mean()) / (sims.sum() + DRAW)) if len(best) else -1.0

    def calibrated(self, vote: float) -> float:
        if vote < 0 or not self.steps[0]:
            return self.rate
        return min(1.0, max(0.0, float(np.interp(vote, *self.steps))))

    def votes(self, words: list[bytes], skip: int | None = None) -> tuple[float, np.ndarray]:
        """The vote of the nearest examples, or -1 if there are none, and who they are."""
        if not len(self.ids):
            return -1.0, np.empty(0, np.int64)
        at, n = self.terms.counts(words)
        if not len(at):
            return -1.0, np.empty(0, np.int64)
        best, sims = self.nearest(at, self.vector(at, n), skip)
        return self.vote(best, sims), best

    def score(self, words: list[bytes]) -> tuple[float, list[int]]:
        vote, best = self.votes(words)
        return self.calibrated(vote), self.ids[best[:3]].tolist()


def _clusters(x: np.ndarray, k: int = 24, rounds: int = 6) -> np.ndarray:
    """Numbers of groups of similar rows; any numbers do, better ones skip more blocks."""
    if len(x) < 2 * k or not x.shape[1]:
        return np.zeros(len(x), np.int64)
    centres = x[:: len(x) // k][:k].copy()
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)
    return of


def _rising(votes: list[float], y: list[int]) -> tuple[list[float], list[float]]:
    """Isotonic regression of labels on votes: a line from pool to pool, and on to both ends, that rises everywhere."""
    pools: list[list[float]] = []  # sum of votes, toxic, rows, last vote
    for v, t in sorted(zip(votes, y, strict=True)):
        pools.append([v, t, 1, v])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][3] == pools[-1][0] / pools[-1][2]):
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2] + b[2], b[3]]
    if not pools:
        return [], []
    x = [s / n for s, _, n, _ in pools]
    z = np.maximum.accumulate([(t + x_) / (n + 1) for x_, (_, t, n, _) in zip(x, pools, strict=True)]).tolist()
    return [min(0.0, x[0] - 1e-9), *x, max(1.0, x[-1] + 1e-9)], [z[0] / 2, *z, (1 + z[-1]) / 2]


def example_votes(rows: DataFrame, model: Model) -> list[tuple[float, int]]:
    """Vote and label of each example, scored without itself."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            got = [shared.value.votes(w, i)[0] for w, i in zip(_texts(b), column(b, "doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), column(b, "toxic")], names=["vote", "toxic"])

    got = [(r.vote, int(r.toxic > 0)) for r in rows.mapInArrow(run, "vote double, toxic int").collect()]
    shared.destroy()
    return got


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    model, rows = Model(), sample(docs, labels)
    words_at, held = sample_words(rows)
    toxic = sum(h[1] for h in held)
    if not toxic or toxic == len(held):
        model.rate = toxic / max(1, len(held))
        return model
    model.terms, lean = learn_terms(words_at, held)
    total, df = document_counts(docs, model.terms)
    model.weight = ((np.log((total + 1) / (df + 1)) + 1) * (FLOOR + lean)).astype(np.float32)
    model.leans = lean > 0
    # terms of each word: itself and the leaning beginnings it has
    begun = [(k, t[1:]) for w, k in words_at.items() if len(t := model.terms.of(w)) > 1]
    del words_at
    more = {k: np.array(t, np.int32) for k, t in begun}
    heads = np.zeros(model.terms.size, bool)
    heads[list(more)] = True
    examples, bare = [], []
    for doc_id, y, words, counts in held:
        if not len(words):
            bare.append(y)
            continue
        with_heads = np.flatnonzero(heads[words])
        extra = [more[int(words[i])] for i in with_heads]
        at = np.concatenate([words, *extra])
        n = np.concatenate([counts, *(np.full(len(x), counts[i]) for x, i in zip(extra, with_heads, strict=True))])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at, n = at[first], np.add.reduceat(n, first)
        examples.append((doc_id, y, at, n))
        if not model.leans[at].any():
            bare.append(y)
    model.rate = (sum(bare) + 0.5) / (len(bare) + 2)
    model.index(examples)
    voted = [v for v in example_votes(rows, model) if v[0] >= 0]
    model.steps = _rising([v[0] for v in voted], [v[1] for v in voted])
    del held, examples
    give_back()
    return model


def with_scores(docs: DataFrame, model: Model, score: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs with score and evidence (doc_ids of the nearest examples); all other columns pass through."""
    bound_batches(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    schema = docs.select("*", F.lit(0.0).alias(score), F.array(F.lit(0).cast("long")).alias(evidence)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            got = [shared.value.score(w) for w in _texts(b)]
            more = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), *more], names=[*names, score, evidence])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more."""
    score, evidence = free_name(docs.columns, "score"), free_name(docs.columns, "evidence")
    return with_scores(docs, fit(docs, labels), score, evidence).where(F.col(score) < 0.5).drop(score, evidence)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
