"""Reading level of documents, from some graded examples.

Method. Documents, their sentences and their words form a graph. Graded documents are
clamped, and continuous difficulty (0 easy, 1 middle, 2 hard) is propagated in harmonic
iterations: a word takes the mean of its sentences, a sentence the precision-weighted
mean of its words, a document the mean of its sentences. Words that stand in sentences of
every difficulty (names, titles, catalogue lines) have a wide spread and so hardly any
weight. As harmonic values shrink towards the mean, every iteration is calibrated on the
clamped documents. Iterations end when the words' values hardly move (``TOLERANCE``). A
document's level is the median of its sentences' difficulty, so single sentences may be
easier or harder, and lines without weight do not count.

Scale. The texts are taken apart once, into checkpointed blocks of a few thousand documents:
each holds the keys of its own distinct words and its documents as numbers into them.
Word values are a distributed table; in an iteration it is joined to the words of the
blocks, the blocks receive the values they need and give back sums by word, of which a
task makes one per distinct word before the shuffle. Words are known by 64-bit hashes.
Nothing about words or single documents goes to the driver; what does is the calibration,
three medians and a residual. The graded examples are bounded by ``max_labels`` (those with
the smallest hash of their id).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacquer.session import cut, cut_by

BANDS = ("easy", "middle", "hard")
#: Graded documents used at most.
MAX_LABELS = 200_000
#: Words a document needs to have a level.
MIN_WORDS = 12
#: Characters and documents from which a block is full.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 5_000
#: Iterations end when the occurrences of words move by less than this on average, or after so many.
TOLERANCE, MOST = 0.02, 10

_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[^\W\d_]\.)\s+(?=[^\d\sa-z])|(?<=[.!?][\"”»)])\s+(?=[^\d\sa-z])|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_SHRINK, _SPREAD, _FLOOR = 0.5, 0.6, 0.05


def sentences(text: str) -> list[list[str]]:
    """The lower-case words of each sentence or line of two words or more."""
    got = (_WORD.findall(s) for s in _SENTENCE.split(text))
    return [[w.lower() for w in ws] for ws in got if len(ws) > 1]


@dataclass
class Scale:
    """The calibration of an iteration: prior, knots, and the median confidence of a sentence."""

    prior: float
    knots: tuple[tuple[float, float], ...] = ()
    usual: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.knots:
            return x
        at, to = zip(*self.knots, strict=True)
        return np.interp(x, at, to)


class Packer:
    """Documents on their way into blocks."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.keys: list = []
        self.y: list[float] = []
        self.n: list[int] = []
        self.words: list[int] = []
        self.lengths: list[int] = []
        self.sentences: list[int] = []
        self.chars = 0

    def add(self, key, text: str, y: float) -> None:
        got = sentences(text)
        for ws in got:
            self.words += [self.ids.setdefault(w, len(self.ids)) for w in ws]
            self.lengths.append(len(ws))
        self.keys.append(key)
        self.y.append(y)
        self.n.append(len(text.split()))
        self.sentences.append(len(got))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.keys) >= BLOCK_DOCS

    def row(self, block: int, example: bool) -> dict:
        pack = lambda x: np.array(x, dtype=np.int32).tobytes()
        vocabulary = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in self.ids]
        return {
            "block": block, "example": example, "keys": self.keys, "y": self.y, "n": self.n, "words": pack(self.words), "lengths": pack(self.lengths),
            "sentences": pack(self.sentences), "vocabulary": vocabulary,
        }


class Block:
    """The documents of a block as flat arrays, with the values of its words where they are given."""

    def __init__(self, row, prior: float):
        self.word = np.frombuffer(row.words, dtype=np.int32)
        self.length = np.frombuffer(row.lengths, dtype=np.int32).astype(np.int64)
        per_doc = np.frombuffer(row.sentences, dtype=np.int32)
        self.of_word = np.repeat(np.arange(len(self.length)), self.length)
        self.doc, self.docs, self.prior = np.repeat(np.arange(len(per_doc)), per_doc), len(per_doc), prior
        self.y = np.asarray(row.y, dtype=float)
        self.vocabulary = np.asarray(row.vocabulary, dtype=np.int64)
        self.v = np.full(len(self.vocabulary), prior)
        self.p = np.full(len(self.vocabulary), 1e-6 / (_SPREAD + _FLOOR) ** 2)
        at = getattr(row, "at", None)
        if at is not None and len(at):
            self.v[at], self.p[at] = row.v, row.p

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Difficulty and confidence of each sentence, and difficulty of each document."""
        v, p, n = self.v[self.word], self.p[self.word], len(self.length)
        a = np.bincount(self.of_word, weights=p, minlength=n)
        own = np.bincount(self.of_word, weights=p * v, minlength=n) / np.maximum(a, 1e-12)
        conf = a / np.maximum(self.length, 1)
        w = np.sqrt(conf) + 1e-6
        d = np.bincount(self.doc, weights=w, minlength=self.docs)
        doc = np.where(d > 0, np.bincount(self.doc, weights=w * own, minlength=self.docs) / np.maximum(d, 1e-12), self.prior)
        return own, conf, doc

    def sums(self, w: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """By word: the sentences' weights, and their sums of values and squares."""
        k, w, v = len(self.vocabulary), w[self.of_word], v[self.of_word]
        return pd.DataFrame({"w": self.vocabulary} | {c: np.bincount(self.word, weights=x, minlength=k) for c, x in (("n", w), ("m", w * v), ("q", w * v * v))})


_BLOCK = "block bigint, example boolean, keys array<{kind}>, y array<double>, n array<int>, words binary, lengths binary, sentences binary, vocabulary array<bigint>"
_SUMS = "w bigint, n double, m double, q double"


def _learn(sums: DataFrame, prior: float) -> DataFrame:
    """The words' values (w, v, p and their weight n) from summed weights."""
    s = sums.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "m", "q")]).where("n > 0")
    v = (F.col("m") + _SHRINK * prior) / (F.col("n") + _SHRINK)
    var = F.greatest((F.col("q") + _SHRINK * (prior**2 + _SPREAD)) / (F.col("n") + _SHRINK) - v * v, F.lit(0.0))
    return s.select("w", v.alias("v"), ((F.col("n") / (F.col("n") + 1)) / ((var + _FLOOR) * (var + _FLOOR))).alias("p"), "n")


def _informed(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with the values of their own words: at (places in the vocabulary), v, p.

    Only words and values move; the blocks were partitioned by their number once.
    """
    need = blocks.select("block", F.posexplode("vocabulary").alias("i", "w"))
    got = need.join(words.select("w", "v", "p"), "w").groupBy("block").agg(F.collect_list(F.struct("i", "v", "p")).alias("x"))
    return blocks.join(got.select("block", F.col("x.i").alias("at"), F.col("x.v").alias("v"), F.col("x.p").alias("p")).hint("shuffle_hash"), "block", "left")


def graded(labels: DataFrame, key: str, band: str, max_labels: int = MAX_LABELS) -> DataFrame:
    """(k, y): each graded document once with its commonest band (ties: the easier), at most ``max_labels``."""
    y = F.when(F.col(band) == "easy", 0.0).when(F.col(band) == "middle", 1.0).when(F.col(band) == "hard", 2.0)
    votes = labels.select(F.col(key).alias("k"), y.alias("y")).where("k is not null and y is not null").groupBy("k", "y").agg(F.count("*").alias("n"))
    one = votes.groupBy("k").agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("y"))
    return one.orderBy(F.xxhash64("k"), "k").limit(max_labels)


def reading_levels(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    band: str = "band",
    most: int = MOST,
    min_words: int = MIN_WORDS,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Each document of at least ``min_words`` words with ``difficulty`` (0 to 2) and ``band``.

    Null, empty and short texts give no row; a text without any graded word is of the
    prior's level; repeated rows each come out. Without graded examples every document is
    ``middle``. A language or word form is not asked for: words carry it.
    """
    kind = dict(docs.dtypes)[key]
    known = cut(graded(labels, key, band, max_labels))
    prior = known.agg(F.avg("y")).first()[0]
    prior = 1.0 if prior is None else float(prior)
    # at most max_labels rows of a key and a number
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(known), "k", "left")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        open_ = {False: Packer(), True: Packer()}
        for pdf in batches:
            for k, t, y in zip(pdf["k"], pdf["t"], pdf["y"].astype(float), strict=True):
                for example in (False, True) if y == y else (False,):
                    open_[example].add(k, t, y)
                    if open_[example].full():
                        yield pd.DataFrame([open_[example].row(number, example)])
                        open_[example], number = Packer(), number + 1
        for example, packer in open_.items():
            if packer.keys:
                yield pd.DataFrame([packer.row(number, example)])
                number += 1

    every = cut_by(texts.mapInPandas(encode, _BLOCK.format(kind=kind)), "block")
    # the graded documents are in blocks of their own besides
    blocks, examples = every.where("not example"), every.where("example")

    def each(rows: DataFrame, of_block, schema: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    yield from of_block(Block(row, prior), row)

        return rows.mapInPandas(run, schema)

    def first(b: Block, row) -> Iterator[pd.DataFrame]:
        yield b.sums(np.ones(len(b.length)), b.y[b.doc])

    def calibrate(words: DataFrame) -> Scale:
        def run(b: Block, row) -> Iterator[pd.DataFrame]:
            _, conf, doc = b.scores()
            yield pd.DataFrame({"y": b.y, "x": doc})
            yield pd.DataFrame({"y": -1.0, "x": conf})

        got = each(_informed(examples, words), run, "y double, x double").groupBy("y").agg(F.percentile_approx("x", 0.5, 10000).alias("m")).collect()
        by = {r["y"]: r["m"] for r in got}
        knots: list[tuple[float, float]] = []
        for y in (0.0, 1.0, 2.0):
            if y in by and (not knots or by[y] > knots[-1][0]):
                knots.append((by[y], y))
        return Scale(prior, tuple(knots), by.get(-1.0) or 0.0)

    def spread(scale: Scale):
        def run(b: Block, row) -> Iterator[pd.DataFrame]:
            own, conf, doc = b.scores()
            fixed = ~np.isnan(b.y)
            mine, up, f = scale(own), np.where(fixed, b.y, scale(doc))[b.doc], fixed[b.doc]
            v = np.where(f, 0.3 * mine + 0.7 * up, 0.7 * mine + 0.3 * up)
            yield b.sums(np.where(f, 1.0, 0.5 * conf / (conf + scale.usual + 1e-12)), v)

        return run

    words = cut(_learn(each(examples, first, _SUMS), prior))
    for i in range(most):
        moved = cut(_learn(each(_informed(blocks, words), spread(calibrate(words)), _SUMS), prior))
        # words that had no value before count from the second iteration on
        change = moved.join(words.select("w", F.col("v").alias("old")), "w").agg((F.sum(F.col("n") * F.abs(F.col("v") - F.col("old"))) / F.sum("n")).alias("r")).first()["r"]
        words = moved
        if i > 0 and (change is None or change < TOLERANCE):
            break
    scale = calibrate(words)

    def grade(b: Block, row) -> Iterator[pd.DataFrame]:
        own, conf, doc = b.scores()
        mine, level = scale(own), scale(doc)
        keep = conf >= 0.3 * scale.usual
        order = np.lexsort((mine[keep], b.doc[keep]))
        d, m = b.doc[keep][order], mine[keep][order]
        at = np.searchsorted(d, np.arange(b.docs + 1))
        for i in range(b.docs):
            if at[i + 1] > at[i]:
                # the lower and the upper median; where they differ the mean decides between them
                lo, hi = m[(at[i] + at[i + 1] - 1) // 2], m[(at[i] + at[i + 1]) // 2]
                level[i] = lo if lo == hi else min(max(level[i], lo), hi)
        names = np.where(level < 0.5, BANDS[0], np.where(level >= 1.5, BANDS[2], BANDS[1]))
        out = pd.DataFrame({"k": list(row.keys), "difficulty": level.astype(float), "band": names})
        yield out[np.asarray(row.n) >= min_words]

    return each(_informed(blocks, words), grade, f"k {kind}, difficulty double, band string").withColumnRenamed("k", key)


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The reading level of every document of at least 12 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return reading_levels(docs, spark.read.parquet(f"{sf_dir}/reading_labels.parquet")).select("doc_id", "band")


def p10_profile(spark, sf_dir: str) -> DataFrame:
    """The corpus by kind of document and reading level."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    levels = reading_levels(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/reading_labels.parquet"))
    kinds = docs.select("doc_id", "kind")
    return levels.join(kinds, "doc_id").groupBy("kind", "band").agg(F.count("*").alias("documents"), F.avg("difficulty").alias("mean_difficulty"))
