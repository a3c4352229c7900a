"""Visually identical text with different characters: one consistent form.

Method. Script-aware repair: characters are brought to composed, ordinary-width,
visible form; then every word that mixes scripts is looked at. Its dominant script is
determined and the letters of the other script are replaced by their look-alikes where
the result is a word of the corpus. Of several possible directions the first whose
result the corpus knows wins (dominant script first). A mixed word that the corpus
knows in no direction is repaired towards its dominant script if every foreign letter
has a look-alike there, since a word of two scripts is never consistent; otherwise it
stays. Words wholly in another script, typographic quotes, dashes, fractions and
ordinal signs stay.

Scale. Plain ASCII values never leave the JVM. Values without a mixed word are done in
one narrow Arrow pass; only rows with a mixed word (a script-class regular expression
in the JVM finds them) take part in shuffles, and the vocabulary is reduced to the
candidate repairs before anything is joined to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike letters of the three scripts, by Latin letter.
CYRILLIC_OF = {
    "a": "а", "c": "с", "e": "е", "h": "һ", "i": "і", "j": "ј", "k": "к", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у", "d": "ԁ", "l": "ӏ",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "Q": "Ԛ", "W": "Ԝ",
}
GREEK_OF = {
    "a": "α", "i": "ι", "k": "κ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "w": "ω", "x": "χ", "y": "γ", "n": "η", "t": "τ", "e": "ε",
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
}
_TO_LATIN = {c: l for t in (CYRILLIC_OF, GREEK_OF) for l, c in t.items()}
LOOKALIKE = {
    "LATIN": _TO_LATIN,
    "CYRILLIC": CYRILLIC_OF | {g: CYRILLIC_OF[l] for l, g in GREEK_OF.items() if l in CYRILLIC_OF},
    "GREEK": GREEK_OF | {c: GREEK_OF[l] for l, c in CYRILLIC_OF.items() if l in GREEK_OF},
}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: Invisible characters that are not of category Cf (fixed values).
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))


@lru_cache(maxsize=65536)
def _char(c: str) -> str:
    """The visible, ordinary-width, unligatured form of one character."""
    cat = unicodedata.category(c)
    if c in INVISIBLE or cat == "Cf":
        return ""
    if cat in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
        return " "
    if cat == "Cc":
        return ""
    if "＀" <= c <= "￯":
        return unicodedata.normalize("NFKC", c)
    if "LIGATURE" in unicodedata.name(c, "") and unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c):
        return unicodedata.normalize("NFKC", c)
    return c


def plain_form(text: str) -> str:
    """Composed accents, ordinary width, no ligatures, U+0020 as the only space, nothing invisible."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(map(_char, text)))


@lru_cache(maxsize=65536)
def script_of(c: str) -> str | None:
    """LATIN, CYRILLIC or GREEK for a letter of one of them, else None."""
    if not c.isalpha() or c in "ªº":
        return None
    name = unicodedata.name(c, "").split(" ")[0]
    return name if name in SCRIPTS else None


def scripts_by_weight(word: str) -> list[str]:
    """The scripts of a word's letters, the dominant one first; ties in the order of SCRIPTS."""
    n = dict.fromkeys(SCRIPTS, 0)
    for c in word:
        if s := script_of(c):
            n[s] += 1
    return sorted((s for s in SCRIPTS if n[s]), key=lambda s: -n[s])


def respell(word: str, script: str) -> str | None:
    """``word`` with all letters of the three scripts in ``script``, or None where one has no look-alike."""
    table, out = LOOKALIKE[script], []
    for c in unicodedata.normalize("NFD", word):
        s = script_of(c)
        if s is None or s == script:
            out.append(c)
        elif c in table:
            out.append(table[c])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def core(word: str) -> str:
    """The key under which the vocabulary knows a word."""
    return _EDGE.sub("", unicodedata.normalize("NFC", word)).lower()


def repairs(word: str) -> list[str]:
    """Possible repairs of a mixed word, the dominant script's first; [] if it isn't mixed."""
    order = scripts_by_weight(word)
    if len(order) < 2:
        return []
    return [r for s in dict.fromkeys([*order, "LATIN"]) if (r := respell(word, s)) is not None]


def repair_text(plain: str, known: frozenset[str] | set[str], unwitnessed: bool = True) -> str:
    """``plain`` with its mixed words repaired; ``known`` are the candidate words the corpus has.

    ``unwitnessed`` words, of which the corpus knows no form, are respelt in their dominant
    script, or stay as they are if it is off.
    """
    out = []
    for token in re.split(r"( +)", plain):
        ways = repairs(token)
        if ways:
            token = next((w for w in ways if core(w) in known), ways[0] if unwitnessed else token)
        elif len(scripts_by_weight(token)) > 1:  # parts in different scripts, e.g. joined by a hyphen
            parts = []
            for p in re.split(r"([\W\d_]+)", token):
                w = repairs(p)
                parts.append(next((x for x in w if core(x) in known), w[0] if unwitnessed else p) if w else p)
            token = "".join(parts)
        out.append(token)
    return unicodedata.normalize("NFC", "".join(out))


def _candidates(plain: str) -> list[str]:
    got: dict[str, None] = {}
    for token in plain.split(" "):
        if len(scripts_by_weight(token)) > 1:
            for w in repairs(token) or [r for p in re.split(r"[\W\d_]+", token) for r in repairs(p)]:
                got[core(w)] = None
    return list(got)


_OTHER = r"\p{IsCyrillic}\p{IsGreek}"
#: A word with letters of two scripts, before any repair.
MIXED = rf"(?U)\p{{IsLatin}}[^\s]*[{_OTHER}]|[{_OTHER}][^\s]*\p{{IsLatin}}|\p{{IsCyrillic}}[^\s]*\p{{IsGreek}}|\p{{IsGreek}}[^\s]*\p{{IsCyrillic}}"


def is_plain(c: Column) -> Column:
    """Whether a value holds printable ASCII only and so is consistent already."""
    return ~c.rlike(r"[^\x20-\x7E]")


def _long(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("_f"),
    ).select(*[f"_k{i}" for i in range(len(keys))], "_f.field", "_f.value").where(F.col("value").isNotNull())


def consistent_form(df: DataFrame, keys: list[str], fields: list[str], unwitnessed: bool = False) -> DataFrame:
    """Every non-null (keys, field, value) with its consistent form ``fixed``.

    Nulls give no row; an empty value stays empty; a value of invisible characters only
    becomes empty; repeated rows each come out; the keys need not be unique as long as
    equal keys have equal values. Extra columns are ignored, whatever their names. A mixed
    word stays if no repair of it is in the corpus, unless ``unwitnessed`` words are to be
    respelt too.
    """
    nk = [f"_k{i}" for i in range(len(keys))]
    long = _long(df, keys, fields)
    types = dict(long.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in nk) + ", field string, value string"
    plain = long.where(is_plain(F.col("value"))).withColumn("fixed", F.col("value"))
    odd = long.where(~is_plain(F.col("value")))

    def simple(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(fixed=[plain_form(v) for v in pdf["value"]])

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [plain_form(v) for v in pdf["value"]]
            yield pdf.assign(plain=p, cands=[_candidates(x) for x in p])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fixed = [repair_text(p, set(h), unwitnessed) for p, h in zip(pdf["plain"], pdf["hits"], strict=True)]
            out = pdf[[*nk, "field", "value"]].assign(fixed=fixed)
            yield out.loc[out.index.repeat(pdf["times"])]

    done = odd.where(~F.col("value").rlike(MIXED)).mapInPandas(simple, head + ", fixed string")
    bad = odd.where(F.col("value").rlike(MIXED)).mapInPandas(mixed, head + ", plain string, cands array<string>")
    cands = bad.select(F.explode("cands").alias("word")).distinct()
    words = (
        long.select(F.explode(F.split(F.lower(F.regexp_replace("value", r"(?U)[\s\p{Z}]+", " ")), " ")).alias("w"))
        .select(F.regexp_replace("w", r"(?U)^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$", "").alias("word"))
        .where("word <> ''")
        .distinct()
        .join(cands, "word", "left_semi")
    )
    hits = (
        bad.select(*nk, "field", "value", "plain", F.posexplode_outer("cands").alias("nth", "word"))
        .join(words.withColumn("hit", F.col("word")), "word", "left")
        .groupBy(*nk, "field", "value", "plain")
        .agg(F.collect_set("hit").alias("hits"), F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("times"))
    )
    out = plain.unionByName(done).unionByName(hits.mapInPandas(settle, head + ", fixed string"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "field", "value", "fixed")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Rows and fields of tracks whose value differs from its consistent form."""
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("row_id", "composer", "title", "tune")
    # plain values are consistent as they are: the filter leaves them out of the union's first arm
    return consistent_form(tracks, ["row_id"], ["composer", "title", "tune"]).where("fixed <> value").select("row_id", "field")
