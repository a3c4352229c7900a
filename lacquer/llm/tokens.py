"""Encoding a corpus with a public byte-level BPE.

Method. Merge replay: the distinct pre-tokens of all documents of a block lie one after
the other in flat arrays of symbols with links to their neighbours. An inverted index
leads from each pair of symbols to its positions, and the merges present are applied in
rank order, each to all its positions at once, updating only the touched neighbours. A
merge makes a symbol that only later merges can use, so one ascending pass is complete.

Scale. Each task replays over the distinct pre-tokens of its own blocks and keeps them
for the next block, so nothing is shuffled, a document never leaves its task, and a hot
source costs nothing extra. What is kept is bounded (``MAX_KEPT`` pre-tokens, then it
starts anew, which changes no result). The vocabulary is a file of fixed size that every
task reads itself from ``path``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: The pre-tokenizer of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a task keeps.
MAX_KEPT = 400_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Replay:
    """A byte-level BPE read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of each of the distinct ``words``."""
        byte_id, merge = self.byte_id, self.merge
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym += [byte_id[b] for b in w.encode("utf-8")]
            sym.append(-1)  # no pair reaches over it
        n = len(sym)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int, int]] = {}
        heap: list[int] = []

        def note(i: int, a: int, b: int) -> None:
            got = merge.get((a, b))
            if got is None:
                return
            rank = got[0]
            if rank in at:
                at[rank].append(i)
            else:
                at[rank] = [i]
                pair_of[rank] = (a, b, got[1])
                heapq.heappush(heap, rank)

        for i in range(n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0:
                note(i, sym[i], sym[i + 1])
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = pair_of[rank]
            for i in sorted(at.pop(rank)):
                j = nxt[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue
                sym[i] = new
                sym[j] = -2  # merged away
                k = nxt[j]
                nxt[i] = k
                if k < n:
                    prv[k] = i
                    if sym[k] >= 0:
                        note(i, new, sym[k])
                p = prv[i]
                if p >= 0 and sym[p] >= 0:
                    note(p, sym[p], new)
        out = []
        for s in starts:
            ids = []
            i = s
            while sym[i] != -1:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def encode_block(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; an empty and a null text have none."""
        split = [self.find(t) if t else [] for t in texts]
        kept = self.kept
        if len(kept) > MAX_KEPT:
            kept.clear()
        new = list({w for ws in split for w in ws if w not in kept})
        for w, ids in zip(new, self.replay(new), strict=True):
            kept[w] = ids
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += kept[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=4)
def load(path: str) -> Replay:
    return Replay(path)


#: Code points encoded at a time within one batch.
BLOCK = 4_000_000


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str, text: str, path: str, ids: str = "ids") -> DataFrame:
    """``key`` and the token ids of ``text``, without special tokens.

    An empty or null text has an empty list, a blank one the ids of its spaces. Strings of
    special tokens are ordinary text. Repeated rows each come out; texts are encoded whole.
    """
    kind = dict(df.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                lists = bpe.encode_block(texts[a:b])
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), F.col("ids").alias(ids))


def token_counts(df: DataFrame, key: str, text: str, path: str, count: str = "n_tokens") -> DataFrame:
    """``key`` and the number of tokens of ``text``; 0 for empty and null texts."""
    kind = dict(df.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [len(x) for a, b in _blocks(texts) for x in bpe.encode_block(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], names=["k", "n"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, n bigint").select(F.col("k").alias(key), F.col("n").alias(count))


def p8_ids(spark, sf_dir: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", path)
