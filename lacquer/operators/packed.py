"""Several values packed in one field: infer the delimiters, split, keep positions.

Method. The rows of a *source* (a caller-chosen column, for instance the shelf a file lies
on) are told apart by format: which candidate delimiters stand in them outside quotes and
brackets. For every source and format each candidate is scored over all rows: how regular
the pieces are that it makes of the pieces of the candidates before it (a name of two
words or more, "Surname, Forename", a group, a quoted value) and how consistent their
number is. Small sources lean on what all sources with that format show. Only candidates
that reach ``LEAST_SCORE`` split: a comma does in "A One, B Two", and does not in
"One, A; Two, B", because of the scores alone. Where a weak delimiter that was chosen
makes irregular pieces of a single row, the row keeps that piece ("Two, Bela" among lists).

The table of scores has one row per source, format and delimiter and comes from a map-side
combined aggregate, so a source with a third of all rows costs no more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacquer.operators.joins import small
from lacquer.session import cut

#: Candidate delimiters in the order in which they are tried.
STRONG = (";", "|", "\n")
WEAK = ("/", "+", ",", "&")
CANDIDATES = (*STRONG, *WEAK)
#: Score from which a candidate splits, and the pieces that the other sources of a format count for.
LEAST_SCORE, LEAN = 0.5, 20
#: Words that introduce guests, and words that join names (fixed values).
GUEST = r"(?:featuring|feat\.?|ft\.?|with)"
JOIN = r"(?:and|&)"
#: Words that mark a group (fixed values); a piece holding one is regular whatever its length.
GROUP_WORD = re.compile(
    r"(?i)\b(?:trio|duo|quartett?|quintett?|sextett?|septett?|octett?|nonet|ensemble|orchestra|orch|ork|band|singers|players|choir|group|qnt|qrt|\d+tet|\d+o)\b"
)
_GUEST = re.compile(rf"(?i)(?<=\s){GUEST}(?=\s)")
_JOIN = re.compile(rf"(?i)(?<=\s){JOIN}(?=\s)")
_BRACKET = re.compile(r"\s*[(\[][^()\[\]]*[)\]]\s*$")
_MASK = "\x00"


def mask(text: str) -> str:
    """``text`` with the inside of quotes and brackets blanked, same length.

    A quote or bracket that is never closed is an ordinary character.
    """
    if '"' not in text and "(" not in text and "[" not in text:
        return text
    out, i, n = list(text), 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = text.find('"', i + 1)
        elif c in "([":
            j = text.find(")" if c == "(" else "]", i + 1)
        else:
            i += 1
            continue
        if j < 0:
            i += 1
            continue
        out[i : j + 1] = _MASK * (j + 1 - i)
        i = j + 1
    return "".join(out)


def _cuts(masked: str, delim: str) -> list[tuple[int, int]]:
    if delim == "&":
        return [m.span() for m in _JOIN.finditer(masked)]
    return [(i, i + 1) for i, c in enumerate(masked) if c == delim]


def _pieces(text: str, masked: str, cuts: list[tuple[int, int]]) -> list[tuple[str, str]]:
    edges = [0, *(x for c in cuts for x in c), len(text)]
    return [(text[a:b], masked[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def regular(piece: str) -> bool:
    """Whether a piece can stand alone: quoted, a group, or a name of two words or more."""
    p = piece.strip()
    if len(p) > 1 and p[0] == p[-1] == '"':
        return True
    p = _BRACKET.sub("", p).strip()
    words = [w for w in re.split(r"[\s,]+", p) if any(c.isalnum() for c in w)]
    if len(words) >= 2:
        return True
    initials = len(words) == 1 and re.fullmatch(r"(?:\w\.)+\w{3,}", words[0]) is not None
    return initials or (len(words) == 1 and GROUP_WORD.search(p) is not None)


def _clean(piece: str) -> str:
    p = piece.strip().strip(";|\n").strip()
    if len(p) > 1 and p[0] == '"':
        m = re.fullmatch(r'"((?:[^"]|"")*)"(\s*[(\[].*)?', p, re.S)
        if m:
            return (m[1].replace('""', '"') + (m[2] or "")).strip()
    return p


def _inverted(pieces: list[str]) -> bool:
    """Whether a comma inside a name explains the pieces: "Surname, Forename", "Name, The"."""
    if len(pieces) != 2:
        return False
    left, right = (p.strip() for p in pieces)
    if _BRACKET.sub("", right).strip().lower() in ("the", "jr.", "jr", "sr.", "sr"):
        return True
    return len(left.split()) == 1 and not GROUP_WORD.search(right) and len(_BRACKET.sub("", right).split()) <= 3 and left != ""


def split_values(text: str | None, chosen: frozenset[str] = frozenset(CANDIDATES)) -> list[str]:
    """The values of one field in the order of the text, split at the ``chosen`` delimiters.

    Null and blank give no value. Words that introduce guests always split.
    """
    if text is None or not text.strip():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    masked = mask(text)
    cuts = [c for d in STRONG if d in chosen and d in masked for c in _cuts(masked, d)]
    listed = bool(cuts)
    cuts += [m.span() for m in _GUEST.finditer(masked)]
    level = _pieces(text, masked, sorted(cuts)) if cuts else [(text, masked)]
    for d in ("/", "+"):
        if d in chosen and d in masked:
            nxt: list[tuple[str, str]] = []
            for piece, m in level:
                parts = _pieces(piece, m, _cuts(m, d))
                if len(parts) > 1 and all(regular(p) for p, _ in parts if p.strip()):
                    nxt += parts
                    listed = True
                else:
                    nxt.append((piece, m))
            level = nxt
    joins = "&" in chosen and _JOIN.search(masked) is not None
    out: list[str] = []
    for piece, m in level:
        if "," in chosen and "," in m:
            out += _commas_and_joins(piece, m, listed, joins)
        else:
            out += _joins(piece, m, joins)
    return [v for v in map(_clean, out) if v and any(c.isalnum() for c in v)]


def _commas_and_joins(piece: str, m: str, listed: bool, joins: bool) -> list[str]:
    if joins:
        # ", and" is one separator
        m2 = re.sub(r",(\s+)(?i:and|&)(?=\s)", lambda k: "," + " " * (len(k[0]) - 1), m)
        if m2 != m:
            piece, m = "".join(p if a == b else " " for p, a, b in zip(piece, m, m2, strict=True)), m2
    kept = [(p, k) for p, k in _pieces(piece, m, _cuts(m, ",")) if p.strip()]
    if len(kept) < 2:
        return _joins(piece, m, joins)
    texts = [p for p, _ in kept]
    if all(regular(p) for p in texts):
        return [v for p, k in kept for v in _joins(p, k, joins)]
    parts = [q for p, k in kept for q in (_joins(p, k, joins))]
    if not listed and len(parts) > 2 and all(regular(p) for p in parts):
        return parts
    if listed or _inverted(texts):
        return _joins(piece, m, joins)
    return [v for q in _rejoin(kept) for v in _joins(*q, joins)]


def _rejoin(kept: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Comma pieces of a list in which a lone word is the surname of the next piece."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(kept):
        p, k = kept[i]
        lone = not regular(p) and len(p.split()) == 1
        if lone and i + 1 < len(kept) and not regular(kept[i + 1][0]):
            out.append((p + "," + kept[i + 1][0], k + _MASK + kept[i + 1][1]))
            i += 2
            continue
        out.append((p, k))
        i += 1
    return out


def _joins(piece: str, m: str, joins: bool) -> list[str]:
    cuts = _cuts(m, "&") if joins else []
    if not cuts:
        return [piece]
    parts = [p for p, _ in _pieces(piece, m, cuts)]
    return parts if all(regular(p) for p in parts if p.strip()) else [piece]


# ---------------------------------------------------------------- distributed part

#: What is quoted or bracketed, as :func:`mask` finds it.
_CLOSED = r'"[^"]*"|\([^)]*\)|\[[^\]]*\]'
_JOINED = r"(?i)\s(?:and|&)\s"
_SPLIT = {d: re.escape(d) for d in CANDIDATES} | {"\n": r"\r\n?|\n", "&": _JOINED}


def format_of(value: Column) -> Column:
    """The candidate delimiters of a field outside quotes and brackets, one after the other."""
    bare = F.regexp_replace(value, _CLOSED, "")
    has = {d: bare.contains(d) for d in CANDIDATES} | {"\n": bare.rlike(r"[\r\n]"), "&": bare.rlike(_JOINED)}
    return F.concat(*[F.when(has[d], F.lit(d)).otherwise(F.lit("")) for d in CANDIDATES])


def _made_by(plain: Column, delim: str) -> Column:
    """The pieces that a candidate makes of the pieces of the candidates before it."""
    before = [_SPLIT[d] for d in CANDIDATES[: CANDIDATES.index(delim)] if d != "&"]
    outer = F.split(plain, "|".join(before)) if before else F.array(plain)
    cut = F.filter(F.transform(outer, lambda p: F.split(p, _SPLIT[delim])), lambda ps: F.size(ps) > 1)
    return F.filter(F.transform(F.flatten(cut), lambda p: F.trim(p)), lambda p: p != "")


def _regular(piece: Column) -> Column:
    """:func:`regular` as an expression; quoted values stand for two words, brackets are off."""
    return piece.rlike(r"[^\s,]*[\p{L}\p{N}][^\s,]*[\s,]+[^\s,]*[\p{L}\p{N}]") | piece.rlike(r"^(?:[\p{L}\p{N}_]\.)+[\p{L}\p{N}_]{3,}$") | piece.rlike(GROUP_WORD.pattern)


def delimiter_scores(df: DataFrame, value: str, source: str) -> DataFrame:
    """Score of every candidate delimiter in every source and format, over all rows.

    Columns: source, format, delim, rows, regularity (share of regular pieces, small
    sources leaning on all sources of that format), consistency (mean squared over mean
    square of the piece counts), score (their product). Nulls and blanks count nowhere; an
    empty table gives an empty table.
    """
    base = df.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(value).alias("_v"), format_of(F.col(value)).alias("format")).where("trim(_v) <> '' and format <> ''")
    plain = F.regexp_replace(F.regexp_replace(F.col("_v"), r'"[^"]*"', "Quoted Value"), r"\([^)]*\)|\[[^\]]*\]", "")
    arms = F.array(*[F.when(F.col("format").contains(d), F.struct(F.lit(d).alias("delim"), _made_by(plain, d).alias("ps"))) for d in CANDIDATES])
    made = base.select("source", "format", F.explode(F.filter(arms, lambda a: a.isNotNull())).alias("a"))
    counted = made.select("source", "format", "a.delim", F.size("a.ps").alias("n"), F.size(F.filter("a.ps", _regular)).alias("good"))
    stats = counted.groupBy("source", "format", "delim").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("good").alias("good"))
    every = Window.partitionBy("format", "delim")  # one row per source
    common = F.sum("good").over(every) / F.greatest(F.sum("n").over(every), F.lit(1))
    stats = stats.withColumn("regularity", (F.col("good") + LEAN * common) / (F.col("n") + LEAN))
    stats = stats.withColumn("consistency", F.when(F.col("nn") > 0, F.col("n") * F.col("n") / (F.col("rows") * F.col("nn"))).otherwise(F.lit(0.0)))
    return stats.select("source", "format", "delim", "rows", "regularity", "consistency", (F.col("regularity") * F.col("consistency")).alias("score"))


def split_packed(df: DataFrame, keys: list[str], fields: list[str], source: str, least_score: float = LEAST_SCORE, at_least: int = 2) -> DataFrame:
    """One row per value: ``keys``, field, pos (from 1), val.

    Only rows with ``at_least`` values come out. Null, blank and delimiter-only fields
    hold no value; empty items do not count; repeated rows are split each on their own;
    very long fields are split whole. Columns other than ``keys`` and ``fields`` are not
    touched, so clashing names (``pos``, ``val``) in the input do no harm.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    long = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("f"),
    ).select(*names, F.col("f.field").alias("field"), F.col("f.v").alias("v"), F.concat_ws("\x1f", "_s", "f.field").alias("_src"))
    long = long.where(F.trim("v") != "")
    scores = delimiter_scores(long, "v", "_src").where(F.col("score") >= least_score)
    chosen = cut(scores.groupBy("source", "format").agg(F.array_join(F.array_sort(F.collect_set("delim")), "").alias("chosen")))
    chosen = small(chosen.select(F.col("source").alias("_src"), F.col("format").alias("_fmt"), "chosen"))
    joined = long.withColumn("_fmt", format_of(F.col("v"))).join(chosen, ["_src", "_fmt"], "left").drop("_src", "_fmt")
    if at_least > 1:
        # without a chosen delimiter only a guest makes a second value
        joined = joined.where(F.col("chosen").isNotNull() | F.col("v").rlike(rf"(?i)\s{GUEST}\s"))
    types = dict(long.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", field string, pos int, val string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str | None, frozenset[str]] = {}
        for pdf in batches:
            known: dict[tuple[str, str | None], list[str]] = {}
            rows: list[int] = []
            pos: list[int] = []
            val: list[str] = []
            for i, (v, c) in enumerate(zip(pdf["v"], pdf["chosen"], strict=True)):
                got = known.get((v, c))
                if got is None:
                    if c not in sets:
                        sets[c] = frozenset(c or "")
                    got = known[v, c] = split_values(v, sets[c])
                if len(got) >= at_least:
                    rows += [i] * len(got)
                    pos += range(1, len(got) + 1)
                    val += got
            out = pdf[[*names, "field"]].iloc[rows].reset_index(drop=True)
            out["pos"] = pd.Series(pos, dtype="int32")
            out["val"] = pd.Series(val, dtype="object")
            yield out

    return joined.mapInPandas(run, schema).select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "field", "pos", "val")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The values of tracks.artist_raw and tracks.personnel where a field holds several.

    The source of a row is the shelf its file lies on, the first folder of its path.
    """
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("row_id", "artist_raw", "personnel", F.substring_index("path", "/", 1).alias("shelf"))
    return split_packed(tracks, ["row_id"], ["artist_raw", "personnel"], "shelf")
