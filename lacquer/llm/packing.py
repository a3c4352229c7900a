"""Filling fixed-capacity containers with items of varying size.

Method. Bound-certified repacking: items are spread over groups of about equal total
size, each group is packed by best-fit decreasing, and dual-feasible functions give a
lower bound of the containers that group needs. A group whose count equals its bound is
certified. Groups with a gap give up their badly filled containers; ``fan_in`` such
groups exchange those items and best-fit decreasing runs again on what they gave up,
and so on for a few rounds in which the pool shrinks geometrically.

Items larger than the capacity are split into full pieces and a rest; no other item is
split. Items of size 0 or less, and of null size, take no space and join any container.

Scale. A group holds about ``target`` units, whatever the input's size, and items reach it
by a hash of their key, so a hot source is spread like any other. Rounds are cut by
checkpoints of ids and sizes only; the texts are read once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacquer.llm.tokens import TOKENIZERS, token_counts
from lacquer.session import cut

CAPACITY = 2048


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; ``sizes`` are in descending order and at most ``capacity``."""
    open_at: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a container with r units of room is open
    out, bins = [], 0
    for s in sizes:
        fit = (rooms >> s) << s
        if fit and s:
            room = (fit & -fit).bit_length() - 1
        elif not s and bins:
            out.append(bins - 1)
            continue
        else:
            room = capacity
            open_at.setdefault(room, []).append(bins)
            rooms |= 1 << room
            bins += 1
        stack = open_at[room]
        b = stack.pop()
        if not stack:
            rooms &= ~(1 << room)
        out.append(b)
        left = room - s
        open_at.setdefault(left, []).append(b)
        rooms |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int, most_k: int = 30) -> int:
    """Containers needed at least for ``counts`` items of each of ``sizes``, by dual-feasible functions.

    The larger of the bounds of the families f_l (items above capacity - l count as full,
    those below l as nothing) and u_k (multiples of 1/(k+1) rounded down to 1/k).
    """
    keep = sizes > 0
    sizes, counts = sizes[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    num = np.concatenate([[0], np.cumsum(counts)])
    best = 0
    for l in {0, *(int(s) for s in sizes if s <= capacity // 2), *(int(capacity - s) for s in sizes if s > capacity // 2)}:
        lo, hi = np.searchsorted(sizes, l, "left"), np.searchsorted(sizes, capacity - l, "right")
        best = max(best, int(num[-1] - num[hi]) + -(-int(mass[hi] - mass[lo]) // capacity) if hi >= lo else 0)
    for k in range(1, most_k + 1):
        scaled = sizes * (k + 1)
        # in units of capacity / k, doubled by capacity to stay whole
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items as pieces of at most ``capacity``: key, piece (from 0), start, size."""
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity).cast("bigint") - 1, F.lit(0))
    rows = df.select(F.col(key).alias("k"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("k", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("size"))


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, target: int = 4_000_000, fan_in: int = 16, rounds: int = 3) -> DataFrame:
    """Every piece of every item with its container: key, piece, start, size, container.

    An empty table gives an empty table. Equal keys are packed as separate items. The
    result is the same whatever the partitioning, as items are ordered by size and key.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = cut(pieces(df, key, size, capacity))
    total = items.agg(F.sum(F.col("size")).alias("s"), F.count("*").alias("c")).first()
    groups = max(1, -(-int(total["s"] or 0) // target), -(-int(total["c"]) // target))
    kind = dict(items.dtypes)["k"]
    schema = f"k {kind}, piece int, start bigint, size bigint, part bigint, round int, container bigint, bins int, bound int, given_up boolean"

    def packer(number: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "k", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            sizes = pdf["size"].to_numpy()
            at = np.array(best_fit_decreasing(sizes.tolist(), capacity), dtype=np.int64)
            fill = np.bincount(at, weights=sizes) if len(at) else np.zeros(0)
            bound = lower_bound(*np.unique(sizes, return_counts=True), capacity)
            gap = len(fill) - max(bound, 1)
            loose = np.zeros(len(fill), dtype=bool)
            if gap > 0 and not last:
                loose = fill < 0.99 * capacity
                full = np.flatnonzero(~loose)
                loose[full[: int(loose.sum())]] = True  # room to exchange against
            return pdf[["k", "piece", "start", "size", "part"]].assign(
                round=np.int32(number), container=at, bins=np.int32(len(fill)), bound=np.int32(bound), given_up=loose[at]
            )

        return run

    todo = items.withColumn("part", F.pmod(F.xxhash64("k", "piece"), F.lit(groups)))
    done = None
    for r in range(rounds):
        last = r == rounds - 1 or groups == 1
        packed = cut(todo.groupBy("part").applyInPandas(packer(r, last), schema))
        kept = packed.where(~F.col("given_up"))
        done = kept if done is None else done.unionByName(kept)
        groups = -(-groups // fan_in)
        if last or packed.where("given_up").isEmpty():
            break
        todo = packed.where("given_up").select("k", "piece", "start", "size", F.floor(F.col("part") / fan_in).alias("part"))
    label = F.format_string("%d-%d-%d", F.col("round"), F.col("part"), F.col("container"))
    return done.select(F.col("k").alias(key), "piece", "start", "size", label.alias("container"))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, the lower bound for all items, and the share of space used.

    The histogram of sizes it collects has at most ``capacity`` + 1 rows.
    """
    spark = packed.sparkSession
    hist = packed.groupBy("size").agg(F.count("*").alias("n")).collect()
    used = packed.agg(F.count_distinct("container").alias("c"), F.sum("size").alias("s"), F.count("*").alias("n")).first()
    bound = lower_bound(np.array([h["size"] for h in hist], dtype=np.int64), np.array([h["n"] for h in hist], dtype=np.int64), capacity)
    share = float(used["s"] or 0) / (used["c"] * capacity) if used["c"] else 0.0
    return spark.createDataFrame([(used["n"], used["c"], bound, share)], "pieces bigint, containers bigint, lower_bound bigint, filled double")


def p9_containers(spark, sf_dir: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """All documents, each as long as its text in tokens, in containers of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_counts(docs, "doc_id", "text", path), "doc_id", "n_tokens", capacity)


def p9_certificate(spark, sf_dir: str) -> DataFrame:
    """How many containers were used and how many are needed at least."""
    return certificate(cut(p9_containers(spark, sf_dir)))
