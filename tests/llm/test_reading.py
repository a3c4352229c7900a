import random

from lacquer.llm.reading import reading_levels, sentences

WORDS = {
    "easy": "the cat sat on a mat and we like it so much".split(),
    "middle": "several musicians recorded another session while most listeners waited outside".split(),
    "hard": "palaeographic indeterminacy vitiates discographical taxonomy notwithstanding contrapuntal equivocation".split(),
}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        band = rnd.choice(list(WORDS))
        mix = [band] * 5 + [rnd.choice(list(WORDS))]
        text = " ".join(" ".join(rnd.choice(WORDS[b]) for _ in range(6)).capitalize() + "." for b in mix)
        out.append((i, text + "\nCatalogue No. 3 Egon Hoduck", band))
    return out


def test_sentences():
    assert sentences("He came. She left! E.M. Hoduck plays No. 3 now.\nA line") == [["he", "came"], ["she", "left"], ["e", "m", "hoduck", "plays", "no", "now"], ["a", "line"]]


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "b") for i, t, _ in rows], "doc_id bigint, text string, band string").select("doc_id", "text")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i % 4 == 0] * 2, "doc_id bigint, band string")
    got = {r.doc_id: r.band for r in reading_levels(docs, labels).collect()}
    held = [(i, b) for i, _, b in rows if i % 4]
    assert len(got) == 600 and sum(got[i] == b for i, b in held) >= 0.97 * len(held)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "too short a text"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (5, "word " * 20000), (5, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, band string")
    got = sorted((r.doc_id, r.band) for r in reading_levels(docs, labels).collect())
    assert got == [(4, "middle"), (5, "middle"), (5, "middle")]
    assert reading_levels(docs.limit(0), labels).count() == 0
