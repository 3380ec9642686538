"""Language-model scores by a causal self-attention model over subword ids, trained in numpy.

Words are what white space parts, in lower case; each text ends with one end token. Two models score a text:

* base: add-one unigrams of words, with counts over every training text of the corpus, exchanged by hashed word.
* model: words are cut into subwords of a public tokenizer. A causal self-attention layer gives each subword a
  probability out of VOCABULARY ids (the commonest of the training texts; the others share one id by their counts), by a
  softmax over CLASSES classes and one over the MEMBERS of the class. What it learns is the departure from smoothed
  counts of subword pairs. A word's probability is that of its subwords, mixed with its share of all training tokens
  (weight MIX), so what is common as a whole is not paid for piece by piece.

Pair counts, word counts and training windows come from every training text and grow with the corpus. Training begins
with one pass over the windows of least hash, about as many as START_BYTES of text have (all of a small corpus). From
there every window of every text is trained on: they are dealt by hash into shards of about SHARD, every shard
goes once over its windows, and the shards' weights are averaged by their windows. Order and shards depend on content alone, not on partitions. Scoring goes in windows
that overlap by CONTEXT: each subword is scored once, with at least CONTEXT before it where the text has them, many
windows a batch, under a causal mask.

Texts whose crc32(doc_id as text) mod 7 is 2 are held out of all training; a null doc_id is not held out. Null and
empty texts hold the end token alone. Repeated rows are counted and scored one by one. Without training texts every
base count is 0 and the model knows no pair. A word that the tokenizer turns into nothing counts as one unknown
subword. Very long texts are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, column, drop_stored, id_and_text, mix, text_buffer, written
from .common import written as stored
from .exchange import bucket_bits, by_block, joined, totals
from .token_counts import model_path

#: Classes are at most 256, members a power of 2.
CLASSES, MEMBERS, WIDTH = 32, 32, 16
_SHIFT = MEMBERS.bit_length() - 1
VOCABULARY = CLASSES * MEMBERS
CONTEXT, STRIDE = 8, 32
WINDOW = CONTEXT + STRIDE
#: Windows of a shard; windows of a step and first rates, of the start and of the shards.
SHARD, BATCH, SHARD_BATCH, RATE, SHARD_RATE = 1 << 14, 48, 192, 0.03, 0.006
#: Text bytes whose windows about make up the start.
START_BYTES = 6 << 20
#: What the shares of single subwords weigh against pair counts.
PRIOR = 300.0
#: Weight of a word's share of all training tokens.
MIX = 0.1
#: Text bytes of a block, windows scored at once, words whose subwords a worker keeps.
BLOCK, AT_ONCE, CACHE = 3 << 20, 192, 300_000
#: Windows whose attention is worked out at once.
SLICE = 48
#: Bytes of a word up to which it is hashed here.
LONG = 64
_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands for the end of a text among its words; no word holds it.
END = b"\n"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Words:
    """Different words by ascending hash, as places in a buffer that has 8 bytes or more behind the last of them."""

    def __init__(self, low: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray):
        self.low, self.at, self.size, self.keys = low, at, size, keys

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, i: int) -> bytes:
        return self.low[self.at[i] : self.at[i] + self.size[i]].tobytes()

    def some(self, which: np.ndarray) -> list[bytes]:
        data, at, size = self.low.tobytes(), self.at[which].tolist(), self.size[which].tolist()
        return [data[a : a + n] for a, n in zip(at, size, strict=True)]


def hashes(low: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a buffer (uint64, 8 bytes or more behind the last piece), by 8 bytes at a time; of long ones by xxhash."""
    eights = low[: len(low) & -8].view(np.uint64)
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = mix(size.astype(np.uint64))
    far = np.flatnonzero(size > LONG)
    left = np.flatnonzero(size <= LONG) if len(far) else slice(None)
    begin, n, own = at[left], size[left], h[left]
    while len(begin):
        k, shift = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
        eight = eights.take(k) >> shift | eights.take(k + 1) << np.uint64(1) << (np.uint64(63) - shift)
        own = mix(own ^ eight & keep.take(np.minimum(n, 8)))
        h[left] = own
        more = np.flatnonzero(n > 8)
        left = more if isinstance(left, slice) else left[more]
        begin, n, own = begin[more] + 8, n[more] - 8, own[more]
    for i in far.tolist():
        h[i] = xxhash.xxh64_intdigest(low[at[i] : at[i] + size[i]])
    return h


def different(low: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[Words, np.ndarray]:
    """The different ones of some words, and each word's place among them."""
    coded = pa.array(hashes(low, at, size)).dictionary_encode()
    keys, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.empty(len(keys), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.arange(len(keys))
    first = first[order]
    return Words(low, at[first], size[first], keys[order]), rank.take(code)


def _buffer(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(16 - len(data) % 8), np.uint8)


def tokens_of(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Different words of texts end to end, and among them the end; each token's place there, each text with its end; and the number of tokens of each text."""
    whole = _buffer(raw.tobytes().translate(_LOWER) + END)
    low = whole[: len(raw)]
    solid = low != 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = off[:-1] < off[1:]  # no word runs on into the next text
    first[off[:-1][full]], last[off[1:][full] - 1] = solid[off[:-1][full]], solid[off[1:][full] - 1]
    starts = np.flatnonzero(first)
    n = np.diff(np.searchsorted(starts, off)) + 1
    words, found = different(whole, np.append(starts, len(raw)), np.append(np.flatnonzero(last) + 1 - starts, len(END)))
    place = np.full(n.sum(), found[-1], np.int32)
    inside = np.ones(len(place), bool)
    inside[np.cumsum(n) - 1] = False
    place[inside] = found[:-1]
    return words, place, n


def laid_out(parts: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of tokens end to end, and how many each token has."""
    n = parts[place]
    return ids[np.repeat((np.cumsum(parts) - parts)[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class _Kept:
    """Words by ascending hash with their subwords, these end to end."""

    def __init__(self):
        self.keys, self.parts, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.parts[at], laid_out(self.parts, self.ids, at)[0]

    def add(self, keys: np.ndarray, parts: np.ndarray, ids: np.ndarray) -> None:
        keys, parts, ids = np.append(self.keys, keys), np.append(self.parts, parts), np.append(self.ids, ids)
        order = np.argsort(keys, kind="stable")
        self.keys, self.parts, self.ids = keys[order], parts[order], laid_out(parts, ids, order)[0]


class Subwords:
    """Words as hashes and ids of subwords; the end is the number behind the last id. Words seen lately are kept, by their hashes."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.unknown = self.sp.vocab_size(), max(0, self.sp.unk_id())
        self.known, self.older = _Kept(), _Kept()

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [[self.size] if w == END else ids or [self.unknown] for w, ids in zip(words, self.sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1), strict=True)]
        parts = np.fromiter(map(len, got), np.int64, len(got))
        return parts, np.fromiter(chain.from_iterable(got), np.uint16, parts.sum())

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of subwords and subwords of different words; those not known yet are cut in one call."""
        if len(self.known.keys) > CACHE:
            self.known, self.older = _Kept(), self.known
        new = np.flatnonzero(self.known.find(words.keys) < 0)
        if len(new):
            there = self.older.find(words.keys[new])
            old, new = new[there >= 0], new[there < 0]
            parts, ids = self.older.get(there[there >= 0])
            if len(new):
                more = self._cut(words.some(new))
                parts, ids = np.append(parts, more[0]), np.append(ids, more[1])
            self.known.add(words.keys[np.append(old, new)], parts, ids)
        return self.known.get(self.known.find(words.keys))

    def of(self, words: list[bytes]) -> list[tuple[int, bytes]]:
        """Hash and ids (as bytes) of words."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        found, place = different(_buffer(b"".join(words)), np.cumsum(size) - size, size)
        parts, ids = self.rows(found)
        each = [i.tobytes() for i in np.split(ids, np.cumsum(parts)[:-1])]
        return [(int(found.keys[i]), each[i]) for i in place.tolist()]

    def block(self, words: Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of different words, ascending; the number of subwords of each and all of them end to end; and each token's place among the hashes."""
        return words.keys, *self.rows(words), place


@lru_cache(maxsize=1)
def kept_subwords(path: str) -> Subwords:
    """One for all tasks of a worker, so words of earlier tasks are known to later ones."""
    return Subwords(path)


def windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end, each with its end: indices of inputs (-1: before the text) and of targets (-1: none)."""
    n = -(-lens // STRIDE)
    doc = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lens) - lens)[doc]
    at = k[:, None] * STRIDE + np.arange(-CONTEXT, STRIDE)  # the place whose subword is to be given
    inputs = np.where(at >= 1, first[:, None] + np.minimum(at, lens[doc][:, None]) - 1, -1)
    out = at[:, CONTEXT:]
    return inputs, np.where(out < lens[doc][:, None], first[:, None] + out, -1)


def _by_id(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by id."""
    ids = ids.astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    two = np.complex64 if rows.dtype == np.float32 else np.complex128  # two numbers are added at once
    out = np.zeros((VOCABULARY, rows.shape[1]), rows.dtype)
    out[ids[first]] = np.add.reduceat(rows.take(order, 0).view(two), first, 0).view(rows.dtype)
    return out


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    """The rows by 1,024, so what is done to some of them finds them in a core's cache."""
    return [rows[i : i + 1024] for i in range(0, len(rows), 1024)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, by 256 rows: for long narrow arrays that is the faster way."""
    n, out = len(a) & -256, np.empty((len(a), b.shape[1]), np.result_type(a, b))
    np.matmul(a[:n].reshape(-1, 256, a.shape[1]), b, out=out[:n].reshape(-1, 256, b.shape[1]))
    np.matmul(a[n:], b, out=out[n:])
    return out


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, by 128 rows: for long narrow arrays that is the faster way."""
    n = len(a) & -128
    out = np.matmul(a[:n].reshape(-1, 128, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, 128, b.shape[1])).sum(0)
    return out + a[n:].T @ b[n:] if n < len(a) else out


class Attention:
    """One causal self-attention layer on top of pair counts. Id 0 stands before each text and ends it.

    pairs: ids before and behind and how often they meet. The tables made of them are laid out where they are used.
    """

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        self.p = {"e": g(VOCABULARY, WIDTH), "pos": g(WINDOW, WIDTH), "q": g(WIDTH, WIDTH), "k": g(WIDTH, WIDTH), "v": g(WIDTH, WIDTH), "last": g(VOCABULARY, WIDTH), "u": np.zeros((WIDTH, CLASSES), np.float32), "m": np.zeros((CLASSES, WIDTH, MEMBERS), np.float32)}
        self.pairs, self.of_class = pairs, None

    def __getstate__(self) -> dict:
        return {"p": self.p, "pairs": self.pairs, "of_class": None}

    def copy(self) -> Attention:
        """The same model with weights of its own; the tables made of pairs are laid out once for all copies."""
        if self.of_class is None:
            self._lay_out()
        own = Attention.__new__(Attention)
        own.__dict__ |= self.__dict__
        own.p = {k: v.copy() for k, v in self.p.items()}
        return own

    def _lay_out(self) -> None:
        before, behind, n = self.pairs
        counts = np.zeros((VOCABULARY, VOCABULARY))
        counts[before, behind] = n
        share = counts.sum(0) + 0.5
        p = (counts + PRIOR * share / share.sum()) / (counts.sum(1, keepdims=True) + PRIOR)
        p = p.reshape(VOCABULARY, CLASSES, MEMBERS)
        of_class = p.sum(2)
        self.in_class = np.log(p / of_class[:, :, None]).astype(np.float32)
        self.of_class = np.log(of_class).astype(np.float32)
        self.mask = (np.arange(WINDOW)[None] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)

    def _hidden(self, x: np.ndarray, keep: bool = True) -> tuple:
        """Hidden values of the targets' places, and before them, if they are to be kept, what the gradients need; for some windows, whose arrays a core's cache can hold."""
        if self.of_class is None:
            self._lay_out()
        p = self.p
        h = p["e"].take(x, 0)
        h += p["pos"]
        across, both = np.ascontiguousarray(h.transpose(0, 2, 1)), self._both()
        rows = STRIDE * (2 if keep else 1)  # the gradients take as much room again
        q, s = np.empty((len(x), rows, WIDTH), h.dtype), np.empty((len(x), rows, WINDOW), h.dtype)
        np.matmul(h[:, CONTEXT:], both, out=q[:, -STRIDE:])  # in the end ds meets the queries, s the gradients of values
        own = s[:, :STRIDE]
        np.matmul(q[:, -STRIDE:], across, out=own)
        if own.size and not own.max() <= 60:
            np.minimum(own, np.float32(60), out=own)  # no sum can overflow, so no maximum needs to come off
        np.exp(own, out=own)
        own *= self.mask
        each = 1 / (own @ np.ones(WINDOW, s.dtype))[..., None]
        seen = own @ h
        a = seen @ p["v"]
        a *= each
        z = p["last"].take(x[:, CONTEXT:], 0)
        z += a
        np.tanh(z, out=z)
        return (h, across, both, q, s, each, seen, a, z) if keep else (z,)

    def _both(self) -> np.ndarray:
        """The weights of queries and keys (scaled) as one: queries meet the inputs themselves, and so do the values."""
        return self.p["q"] @ self.p["k"].T * np.float32(WIDTH**-0.5)

    def _targets(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple:
        """Targets in order of their classes: places, classes, members, hidden values, weights of classes and of members, and where classes begin."""
        place = np.flatnonzero(y.ravel() >= 0)
        place = place[np.argsort((y.ravel()[place] >> _SHIFT).astype(np.uint8), kind="stable")]
        y = y.ravel()[place]
        c, member = y >> _SHIFT, y & (MEMBERS - 1)
        before, z = x[:, CONTEXT:].ravel()[place], z.reshape(-1, WIDTH).take(place, 0)
        classes = np.empty((len(place), CLASSES), z.dtype)
        for some, at, of in zip(_parts(classes), _parts(before), _parts(z), strict=True):
            np.matmul(of, self.p["u"], out=some)
            some += self.of_class.take(at, 0)
        members = self.in_class.reshape(-1, MEMBERS).take(before * CLASSES + c, 0)
        cut = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        for k in range(CLASSES):
            if cut[k] < cut[k + 1]:
                members[cut[k] : cut[k + 1]] += z[cut[k] : cut[k + 1]] @ self.p["m"][k]
        return place, c, member, z, classes, members, cut

    def _small(self) -> bool:
        """Tables of logs lie below 0 and hidden values within 1, so small weights leave no exponential to overflow."""
        return max(np.abs(self.p["u"]).sum(0).max(), np.abs(self.p["m"]).sum(1).max()) < 60

    def log_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability; 0 where the target is negative."""
        z = np.concatenate([self._hidden(x[i : i + SLICE], False)[-1] for i in range(0, len(x), SLICE)] or [np.empty((0, STRIDE, WIDTH), np.float32)])
        place, c, member, _, classes, members, _ = self._targets(x, y, z)
        out, total, small = np.zeros(y.size), np.zeros(len(place)), self._small()
        for logits, at in ((classes, c), (members, member)):
            if not small:
                logits -= logits.max(1, keepdims=True)
            total += logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + at)
            ones = np.ones(logits.shape[1], logits.dtype)
            for some in _parts(logits):
                np.exp(some, out=some)
            total -= np.log(logits @ ones)
        out[place] = total
        return out.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, kept = self.p, [self._hidden(x[i : i + SLICE]) for i in range(0, len(x), SLICE)]
        z = np.concatenate([k[-1] for k in kept])
        place, c, member, zt, classes, members, cut = self._targets(x, y, z)
        small, each = self._small(), np.float32(1 / max(1, len(place)))
        for logits, at in ((classes, c), (members, member)):
            if not small:
                logits -= logits.max(1, keepdims=True)
            ones = np.ones(logits.shape[1], logits.dtype)
            for some in _parts(logits):
                np.exp(some, out=some)
                some *= (each / (some @ ones))[:, None]
            logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + at] -= each
        g = {"u": _outer(zt, classes), "m": np.zeros_like(p["m"])}
        dt = _times(classes, np.ascontiguousarray(p["u"].T))
        for j in range(CLASSES):
            if cut[j] < cut[j + 1]:
                some = slice(cut[j], cut[j + 1])
                np.matmul(zt[some].T, members[some], out=g["m"][j])
                dt[some] += members[some] @ p["m"][j].T
        dz = np.zeros((y.size, WIDTH), dt.dtype)
        dz[place] = dt
        do = dz.reshape(*y.shape, WIDTH)
        dh, of_both, of_v = np.empty((*x.shape, WIDTH), dt.dtype), 0, 0
        for i, one in zip(range(0, len(x), SLICE), kept, strict=True):
            dh[i : i + SLICE], more, of_values = self._attention_gradients(do[i : i + SLICE], *one)
            of_both, of_v = of_both + more, of_v + of_values
        of_both = of_both * np.float32(WIDTH**-0.5)
        g["q"], g["k"], g["v"] = of_both @ p["k"], of_both.T @ p["q"], of_v
        g["pos"] = dh.sum(0)
        for name, at, what in (("e", x, dh), ("last", x[:, CONTEXT:], do)):
            g[name] = _by_id(at.ravel(), what.reshape(-1, WIDTH))
        return g

    def _attention_gradients(self, do: np.ndarray, h: np.ndarray, across: np.ndarray, both: np.ndarray, q: np.ndarray, s: np.ndarray, each: np.ndarray, seen: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the gradients of some windows' hidden values, which become those before tanh: of h, and of the weights of queries with keys and of values."""
        np.multiply(z, z, out=z)
        np.subtract(1, z, out=z)
        do *= z
        dn = do * each  # s is not divided by its sums
        own, ds = s[:, :STRIDE], s[:, STRIDE:]
        np.matmul(dn, self.p["v"].T, out=q[:, :STRIDE])
        np.matmul(q[:, :STRIDE], across, out=ds)
        a *= dn
        ds -= (a @ np.ones(WIDTH, dn.dtype))[..., None]
        ds *= own
        dq = ds @ h
        dh = s.transpose(0, 2, 1) @ q
        dh[:, CONTEXT:] += dq @ both.T
        return dh, (across[:, :, CONTEXT:] @ dq).sum(0), _outer(seen.reshape(-1, WIDTH), dn.reshape(-1, WIDTH))

    def train(self, rows: np.ndarray, top: float, batch: int) -> None:
        """One pass over windows (WINDOW inputs and the last target, ids, -1 behind the text) in the order given."""
        names, p = list(self.p), np.concatenate([v.ravel() for v in self.p.values()])
        ends = np.cumsum([self.p[k].size for k in names])
        self.p = {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(p, ends[:-1]), strict=True)}  # views
        m, w = np.zeros_like(p), np.zeros_like(p)
        steps = -(-len(rows) // batch)
        for t in range(1, steps + 1):
            some = rows[(t - 1) * batch : t * batch]
            rate = top * min(1, 2 * (1 - t / (steps + 1)))
            of = self.gradients(np.maximum(some[:, :WINDOW], 0), some[:, CONTEXT + 1 :])
            g = np.concatenate([of[k].ravel() for k in names])
            m += 0.1 * (g - m)
            g *= g
            g -= w
            g *= 0.01
            w += g
            np.divide(w, 1 - 0.99**t, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate / (1 - 0.9**t)
            p -= g

    def score(self, stream: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Natural log probability of each id of the texts."""
        rows, number = training_windows(stream.astype(np.uint16), lens, 0), np.arange(_NONE + 1)
        number[_NONE], out = -1, [np.empty(0)]
        for a in range(0, len(rows), AT_ONCE):
            some = number.take(rows[a : a + AT_ONCE])
            y = some[:, CONTEXT + 1 :]
            out.append(self.log_probability(np.maximum(some[:, :WINDOW], 0), y)[y >= 0])  # in the order of the texts
        return np.concatenate(out)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, keys ascending."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


_NONE = 65535


BLOCKS = "block_id long, doc_ids array<long>, held array<boolean>, lens binary, places binary, parts binary, ids binary, keys binary, counts binary, windows binary, first_windows binary, n_windows long, part int, pairs binary, pair_counts binary"


def gathered(docs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Stored, from one pass over all texts: blocks of texts as places of their words among the block's hashes, with the
    subwords and training counts of these and the training windows (raw ids; those of the start apart); and a row a task, without block_id, that
    counts pairs of subwords in training texts. Beside it the tokenizer's path."""
    rows = id_and_text(docs).withColumn("held", held_out())
    size = rows.where("NOT held").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    start = min(2**64 - 1, (START_BYTES << 64) // max(size, 1))
    fields = [f.split() for f in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}

    def row(**got) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([got.get(n)], kinds[k]) for n, k in fields], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, z = kept_subwords(path), zstandard.ZstdCompressor(level=3)
        part, at = TaskContext.get().partitionId(), 0
        keys, counts, size = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
        for b in blocks(batches, BLOCK):
            raw, off = text_buffer(column(b, "text"))
            held = np.asarray(column(b, "held").to_pylist(), bool)
            tokens, place, n = tokens_of(raw, off)
            words, parts, ids, place = subwords.block(tokens, place)
            trained = np.repeat(~held, n)
            n_words = np.bincount(place[trained], minlength=len(words)).astype(np.uint32)
            got, first = np.empty((0, WINDOW + 1), np.uint16), np.empty(0, bool)
            if trained.any():
                stream, each = laid_out(parts, ids, place[trained])
                lens = np.add.reduceat(each, np.cumsum(n[~held]) - n[~held])
                before = np.append(np.uint16(subwords.size), stream[:-1]).astype(np.uint32)
                k, c = np.unique(before << np.uint32(16) | stream, return_counts=True)
                keys.append(k.astype(np.uint64))
                counts.append(c.astype(np.uint64))
                size += len(k)
                got = training_windows(stream, lens, subwords.size)
                first = _window_hash(got) < np.uint64(start)
            if size > 2_000_000:
                k, c = _merged(keys, counts)
                keys, counts, size = [k], [c], 0
            planes = np.ascontiguousarray(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)  # bytes of one weight together
            blobs = {"lens": n.tobytes(), "places": z.compress(planes.tobytes()), "parts": z.compress(parts.astype(np.uint32).tobytes()), "ids": z.compress(ids.tobytes()), "keys": words.tobytes(), "counts": n_words.tobytes(), "windows": z.compress(got[~first].tobytes()), "first_windows": z.compress(got[first].tobytes())}
            yield row(block_id=(part << 32) + at, doc_ids=column(b, "doc_id").to_pylist(), held=held.tolist(), n_windows=len(got), **blobs)
            at += 1
        k, c = _merged(keys, counts)
        if len(k):
            yield row(part=part % 64, pairs=zlib.compress(k.tobytes(), 1), pair_counts=zlib.compress(c.tobytes(), 1))

    return written(rows, "lm-gathered", run, BLOCKS), path


def training_windows(stream: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """All windows of the texts: WINDOW inputs and the last target, as raw ids."""
    n = -(-lens // STRIDE)
    room = CONTEXT + 1 + n * STRIDE  # each text behind the ends before it, filled up to whole strides
    begins = np.cumsum(room) - room
    laid = np.full(max(room.sum(), WINDOW + 1), _NONE, np.uint16)
    laid[begins[:, None] + np.arange(CONTEXT + 1)] = end
    laid[np.repeat(begins + CONTEXT + 1 - (np.cumsum(lens) - lens), lens) + np.arange(len(stream))] = stream
    at = np.repeat(begins, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.lib.stride_tricks.sliding_window_view(laid, WINDOW + 1)[at]


def _window_hash(rows: np.ndarray) -> np.ndarray:
    """By all ids, four at a time."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 4) * 4), np.uint16)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for four in wide.view(np.uint64).T:
        h = h * np.uint64(0x9E3779B97F4A7C15) + four + np.uint64(1)
    return mix(h)


def pair_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (id before << 16 | id behind) and their counts; their number is bounded by the tokenizer's ids."""
    unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint64)

    def added(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in group:
            for x, y in zip(column(b, "pairs"), column(b, "pair_counts"), strict=True):
                k, c = _merged([k, unpack(x.as_buffer())], [c, unpack(y.as_buffer())])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (k, c)], names=["pairs", "pair_counts"])

    k, c = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for r in table.where("part is not null").select("part", "pairs", "pair_counts").groupBy("part").applyInArrow(added, "pairs binary, pair_counts binary").toLocalIterator():
        k, c = _merged([k, unpack(bytes(r.pairs))], [c, unpack(bytes(r.pair_counts))])
    return k, c


def numbered(k: np.ndarray, c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Each raw id's number (0: the end, 1: any rare one), its log share of its number, and the pairs by numbers."""
    counts = np.bincount((k & np.uint64(0xFFFF)).astype(np.int64), c.astype(np.float64), size + 1)
    order = np.argsort(-counts[:size], kind="stable")
    number = np.ones(size + 1, np.int64)
    number[order[: VOCABULARY - 2]] = np.arange(2, 2 + min(size, VOCABULARY - 2))
    number[size] = 0
    share = np.zeros(size + 1)
    rare = number == 1
    share[rare] = np.log((counts[rare] + 0.5) / (counts[rare] + 0.5).sum())
    before, behind = number[(k >> np.uint64(16)).astype(np.int64)], number[(k & np.uint64(0xFFFF)).astype(np.int64)]
    both, n = _merged([(before * VOCABULARY + behind).astype(np.uint64)], [c])
    before, behind = np.divmod(both.astype(np.int64), VOCABULARY)
    return number, share, (before.astype(np.int32), behind.astype(np.int32), n.astype(np.float64))


def _opened(x: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x.as_buffer(), max_output_size=1 << 31)


def _pass(table: DataFrame, model: Attention, number: np.ndarray, shards: int, rate: float, batch: int, start: bool = False) -> None:
    """Every shard of all windows (or of those of the start) trains from the model as it is; their weights' mean becomes the model's."""
    shared = table.sparkSession.sparkContext.broadcast((model, number))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in chain.from_iterable(b.columns):
                rows = np.frombuffer(_opened(x), np.uint16).reshape(-1, WINDOW + 1)
                if not len(rows):
                    continue
                shard = (_window_hash(rows) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
                groups = np.split(order, at[1:])
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[g[0]]) for g in groups], pa.int32()), pa.array([rows[g].tobytes() for g in groups], pa.binary())], names=["shard", "windows"])

    def train(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, WINDOW + 1) for b in group for x in column(b, "windows")])
        h = _window_hash(rows)
        rows, h = rows[np.argsort(h, kind="stable")], np.sort(h)
        nth = np.arange(len(h)) - np.searchsorted(h, h)
        rows = rows[np.argsort(mix(h + nth.astype(np.uint64)), kind="stable")]  # whatever way they came, copies apart
        model, number = shared.value
        own = model.copy()
        numbers = np.full(_NONE + 1, -1)
        numbers[: len(number)] = number
        own.train(numbers.take(rows), rate, batch)
        flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["shard", "n", "weights"])

    def added(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in group:
            for k, x in zip(column(b, "n").to_pylist(), column(b, "weights"), strict=True):
                total, n = total + k * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["some", "n", "weights"])

    dealt = table.where("n_windows > 0").select("first_windows", *([] if start else ["windows"])).mapInArrow(deal, "shard int, windows binary").groupBy("shard").applyInArrow(train, "shard int, n long, weights binary")
    trained = stored(dealt, "lm-weights")
    sums = trained.orderBy("shard").select(F.expr("shard div 64").cast("int").alias("some"), "n", "weights").groupBy("some").applyInArrow(added, "some int, n long, weights binary")
    mean, seen = 0.0, 0
    for r in sums.orderBy("some").toLocalIterator():
        mean, seen = mean + np.frombuffer(bytes(r.weights), np.float64), seen + r.n
    shared.destroy()
    drop_stored(trained)
    at = 0
    for k in sorted(model.p) if seen else ():
        model.p[k] = (mean[at : at + model.p[k].size] / seen).reshape(model.p[k].shape).astype(np.float32)
        at += model.p[k].size


def learn(table: DataFrame, path: str) -> tuple[Attention, np.ndarray, np.ndarray]:
    """From what was gathered: the trained model, each raw subword id's number, and its log share of that number."""
    number, share, pairs = numbered(*pair_counts(table), Subwords(path).size)
    model = Attention(pairs)
    n = table.agg(F.sum("n_windows")).first()[0] or 0
    if n:
        _pass(table, model, number, 1, RATE, BATCH, start=True)
        _pass(table, model, number, int(-(-n // SHARD)), SHARD_RATE, SHARD_BATCH)
    return model, number, share


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    table, path = gathered(docs, path or model_path())
    learned = learn(table, path)
    texts = table.where("block_id is not null")
    found = stored(totals(texts, bucket_bits((texts.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0] or 0) / 8)), "word-totals")
    n, v = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, share = shared.value
        for b in batches:
            for r in range(b.num_rows):
                lens = np.frombuffer(column(b, "lens")[r].as_buffer(), np.int64)
                planes = np.frombuffer(_opened(column(b, "places")[r]), np.uint8).reshape(4, -1)
                place = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
                parts = np.frombuffer(_opened(column(b, "parts")[r]), np.uint32).astype(np.int64)
                c, doc = joined(column(b, "parts_found")[r]).astype(np.float64), np.repeat(np.arange(len(lens)), lens)  # of each word
                base = np.bincount(doc, np.log10((c + 1) / (n + 1 * (v + 1)))[place], len(lens))
                stream, each = laid_out(parts, np.frombuffer(_opened(column(b, "ids")[r]), np.uint16), place)
                logs = model.score(number[stream], np.add.reduceat(each, np.cumsum(lens) - lens)) + share[stream]
                logs = np.add.reduceat(logs, np.cumsum(each) - each)  # of each token
                if n:
                    whole = (c * (MIX / n))[place]
                    logs += np.log1p(-MIX)
                    logs = np.where(whole > 0, np.log(np.where(whole > 0, whole + np.exp(logs), 1)), logs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column(b, "doc_ids")[r].as_py(), pa.int64()),
                        pa.array(column(b, "held")[r].as_py(), pa.bool_()),
                        pa.array(lens, pa.int64()),
                        pa.array(np.bincount(doc, (c > 0)[place], len(lens)).astype(np.int64), pa.int64()),
                        pa.array([n] * len(lens), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(np.bincount(doc, logs, len(lens)) / np.log(10), pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    found = by_block(found).withColumnRenamed("parts", "parts_found")
    return texts.select("block_id", "doc_ids", "held", "lens", "places", "parts", "ids").join(found, "block_id").mapInArrow(run, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
