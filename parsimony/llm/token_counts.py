"""Token counts with the whole-token shortcut.

A pre-token is a run of spaces with the word behind it. No piece of the vocabulary holds a space behind
another character, so merges never cross a pre-token's start and each one can be encoded alone. Offline (once
a worker) every vocabulary string that encodes alone as one token is proven by encoding it; pre-tokens that
equal one count directly, and only the rest are merged, with a bounded cache of their counts.

Null and empty texts have 0 tokens. Repeated rows each get their own count. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bound_batches, column, id_and_text

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Merged pre-tokens kept in a worker; beyond it the cache starts anew, counts stay the same.
CACHE = 120_000
_RUNS = re.compile(" +[^ ]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts a text's tokens as the sentencepiece library does, pre-token by pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self.sp.encode(" ", out_type=str) != []
        heads = [p[1:].replace(SPACE, " ") for p in pieces if p.startswith(SPACE) and len(p) > 1]
        #: The proof: encoded alone, with the dummy space in front, it is one token.
        self.proven = {h: 1 for h, ids in zip(heads, self.sp.encode(heads, num_threads=1), strict=True) if len(ids) == 1}
        if self.sp.piece_to_id(SPACE) != self.sp.unk_id():
            self.proven[""] = 1
        else:
            self.splits = False
        self.known = dict(self.proven)

    def forget(self) -> None:
        """Back to what is proven; the worker goes on to other tasks, also of other operators."""
        self.known = dict(self.proven)

    def pretokens(self, text: str) -> list[str]:
        """Each without its first space, which the library's dummy prefix gives back."""
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in _RUNS.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what is not known yet in all of them is merged in one call."""
        if not self.splits:  # a vocabulary without the property that the shortcut needs
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        pre = [self.pretokens(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known = dict(self.proven)
        rest = list(set(chain.from_iterable(pre)).difference(self.known))
        self.known.update(zip(rest, map(len, self.sp.encode(rest, num_threads=1)), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in pre]


_counters: dict[str, PieceCounter] = {}


def counter(path: str | None = None) -> PieceCounter:
    """One counter for each worker and model; path None: the public model where the worker runs."""
    path = path or model_path()
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs with a column of token counts; all other columns pass through unread."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path).counts
        for b in blocks(batches, 1 << 20, text):
            n = pa.array(counts([t or "" for t in column(b, text).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), n], names=[*names, out])
        counter(path).forget()

    return docs.select(*names).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    counted = with_token_counts(id_and_text(docs), path=path)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
