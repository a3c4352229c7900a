import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lacquer.llm.packing import best_fit_decreasing, certificate, lower_bound, pack
from lacquer.llm.tokens import TOKENIZERS, encode, load, token_counts

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
TEXTS = ["", None, "Hello world, it's we'll", "aaaaaaaaaaa bbbb", "  \n\n x\t", "Étude 冬のワルツ 🎷🎷", "<|endoftext|>", "ab" * 3000, "1234567 ½", "don't DON'T"]


def test_ids_equal_the_library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("ab cdeéß \n'st1.,") for _ in range(rnd.randrange(200))) for _ in range(200)]
    bpe = load(PATH)
    got = bpe.encode_block(texts)
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [bpe.decode(g) for g in got] == [x or "" for x in texts]


def test_operator(spark):
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(TEXTS)] * 2, "doc_id bigint, text string, ids string")
    got = encode(df, "doc_id", "text", PATH).collect()
    assert len(got) == 2 * len(TEXTS) and {r.doc_id: list(r.ids) for r in got}[0] == [] == {r.doc_id: list(r.ids) for r in got}[1]
    n = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text", PATH).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got)
    assert encode(df.limit(0), "doc_id", "text", PATH).count() == 0


def exact_bins(sizes, cap):
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= sizes[i]:
                room[j] -= sizes[i]
                go(i + 1, room)
                room[j] += sizes[i]
        go(i + 1, [*room, cap - sizes[i]])

    go(0, [])
    return best


def test_bound_and_fit():
    rnd = random.Random(4)
    for _ in range(60):
        cap = rnd.randrange(5, 25)
        sizes = sorted((rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 9))), reverse=True)
        at = best_fit_decreasing(sizes, cap)
        fill = np.bincount(at, weights=sizes)
        best = exact_bins(sizes, cap)
        assert fill.max() <= cap
        assert lower_bound(*np.unique(sizes, return_counts=True), cap) <= best <= len(fill)


@pytest.mark.parametrize("target", [300, 4_000_000])
def test_packing(spark, target):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 3, 40, 60, 99, 250, None])) for i in range(400)] + [(7, 10), (7, 10)]
    df = spark.createDataFrame(rows, "k bigint, n int")
    got = pack(df, "k", "n", 100, target=target).collect()
    fill, covered = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
        covered[r.k] = covered.get(r.k, 0) + r["size"]
        assert r["size"] == 100 or r.start == 100 * r.piece
    assert max(fill.values()) <= 100
    want = {}
    for k, n in rows:
        want[k] = want.get(k, 0) + (n or 0)
    assert covered == want
    c = certificate(pack(df, "k", "n", 100, target=target), 100).first()
    assert c.lower_bound <= c.containers
    assert pack(df.limit(0), "k", "n", 100).count() == 0
