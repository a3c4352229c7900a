"""Deeply nested records as related flat tables that keep parent and position.

Method. Every record is parsed once and walked as a stream of path-value-ordinal
triples: the path of a leaf with ``*`` for an array position, its scalar value, and the
ordinals at the stars. Paths are grouped by their deepest repeated ancestor, and each
group is pivoted into the rows of one table: the table's path, the ordinals that name
the row, those of its parent, and the fields relative to the ancestor. A record is never
split over tasks, so the grouping and the pivot stay inside one narrow Arrow pass and
nothing is shuffled; a table is then a filter and a projection.

Paths are written like JSON pointers: ``/streams/*/tags/TITLE``; ``~1`` is a slash and
``~0`` a tilde in a key. The table of a record's own fields is ``""``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "path string, ordinals array<int>, value string, kind string"
ROWS = "table_path string, ordinals array<int>, parent_path string, parent_ordinals array<int>, fields map<string,string>, kinds map<string,string>"

def _no_constant(name: str):
    raise ValueError(name)


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The value of strict JSON nested to any depth: open containers lie on a list instead of the call stack."""
    open_: list[tuple[object, str | None]] = []  # container, key that waits for its value
    skip = lambda i: _SPACE.match(text, i).end()
    i, want = skip(0), "value"

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        key, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return key, skip(i + 1)

    value = None
    while True:
        if want == "value":
            c = text[i : i + 1]
            if c and c in "{[":
                box: object = {} if c == "{" else []
                i, key = skip(i + 1), None
                if text[i : i + 1] == ("}" if c == "{" else "]"):
                    value, i, want = box, i + 1, "end"
                else:
                    if c == "{":
                        key, i = name(i)
                    open_.append((box, key))
                continue
            if c == '"':
                value, i = scanstring(text, i + 1, True)
            elif word := next((w for w in _WORDS if text.startswith(w, i)), None):
                value, i = _WORDS[word], i + len(word)
            elif m := _NUMBER.match(text, i):
                value, i = (float if m[1] or m[2] else int)(m[0]), m.end()
            else:
                raise ValueError(i)
            want = "end"
        i = skip(i)
        if not open_:
            if i < len(text):
                raise ValueError(i)
            return value
        box, key = open_[-1]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        c = text[i : i + 1]
        if c == ",":
            i = skip(i + 1)
            if isinstance(box, dict):
                key, i = name(i)
                open_[-1] = (box, key)
            want = "value"
        elif c and c == ("}" if isinstance(box, dict) else "]"):
            open_.pop()
            value, i = box, i + 1
        else:
            raise ValueError(i)


def parse(text: str | None):
    """(parsed, value) of strict JSON: no NaN or Infinity, nothing after the value, any depth."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        try:
            return True, parse_deep(text)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def _key(k: str) -> str:
    return k.replace("~", "~0").replace("/", "~1")


def _utf8(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


@lru_cache(maxsize=10_000)
def _leads(path: str, only: tuple[str, ...]) -> bool:
    """Whether a path leads to, or lies in, one of the wanted ones."""
    return any(path.startswith(p) or p.startswith(path) for p in only)


def triples(value, only: tuple[str, ...] = ()) -> list[tuple[str, tuple[int, ...], str | None, str]]:
    """The leaves of a parsed record: path, ordinals, value as text, kind. Empty containers are leaves.

    With ``only`` nothing outside these paths is walked.
    """
    out: list[tuple[str, tuple[int, ...], str | None, str]] = []
    todo: list[tuple[str, tuple[int, ...], object]] = [("", (), value)]
    while todo:
        path, at, v = todo.pop()
        if only and not _leads(path, only):
            continue
        if isinstance(v, dict) and v:
            todo += [(f"{path}/{_key(k)}", at, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            todo += [(f"{path}/*", (*at, i), x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict | list):
            out.append((path, at, None, "object" if isinstance(v, dict) else "array"))
        elif v is None:
            out.append((path, at, None, "null"))
        elif isinstance(v, bool):
            out.append((path, at, "true" if v else "false", "boolean"))
        else:
            out.append((path, at, str(v), "string" if isinstance(v, str) else "number"))
    return [(_utf8(p), at, None if v is None else _utf8(v), k) for p, at, v, k in out]


def pivot(leaves: list[tuple[str, tuple[int, ...], str | None, str]]) -> dict[tuple[str, tuple[int, ...]], dict[str, tuple[str | None, str]]]:
    """Leaves grouped by deepest repeated ancestor and ordinals, each group a row of fields."""
    rows: dict[tuple[str, tuple[int, ...]], dict[str, tuple[str | None, str]]] = {}
    for path, at, v, kind in leaves:
        cut = path.rfind("/*")
        table, field = ("", path) if cut < 0 else (path[: cut + 2], path[cut + 2 :])
        rows.setdefault((table, at), {})[field] = (v, kind)
    return rows


def shred(df: DataFrame, key: str, record: str) -> DataFrame:
    """One row per row of every flat table in the JSON column ``record``, with ``key``.

    Fields are named by their path below the table's path, ``""`` for the element itself.
    A null or invalid record gives none; a key repeated in one object keeps its last
    value; equal records each give their rows. Other columns are ignored.
    """
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["r"], strict=True):
                ok, value = parse(text)
                if not ok:
                    continue
                for (table, at), fields in pivot(triples(value)).items():
                    up = table[: max(table[:-2].rfind("/*") + 2, 0)] if table else None
                    if table and "/*" not in table[:-2]:
                        up = ""
                    out.append((k, table, list(at), up, list(at[:-1]), {f: v for f, (v, _) in fields.items()}, {f: q for f, (_, q) in fields.items()}))
            yield pd.DataFrame(out, columns=["k", "table_path", "ordinals", "parent_path", "parent_ordinals", "fields", "kinds"])

    src = df.select(F.col(key).alias("k"), F.col(record).alias("r")).where(F.col("r").isNotNull())
    return src.mapInPandas(run, f"k {types[key]}, {ROWS}").withColumnRenamed("k", key)


def path_values(df: DataFrame, key: str, record: str) -> DataFrame:
    """The triples of the JSON column ``record`` as rows, with ``key`` and their order ``seq``."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["r"], strict=True):
                ok, value = parse(text)
                if ok:
                    out += [(k, i, p, list(at), v, kind) for i, (p, at, v, kind) in enumerate(triples(value))]
            yield pd.DataFrame(out, columns=["k", "seq", "path", "ordinals", "value", "kind"])

    src = df.select(F.col(key).alias("k"), F.col(record).alias("r")).where(F.col("r").isNotNull())
    return src.mapInPandas(run, f"k {types[key]}, seq int, {TRIPLES}").withColumnRenamed("k", key)


def flat_table(shredded: DataFrame, key: str, table: str, fields: dict[str, str]) -> DataFrame:
    """One of the flat tables: ``key``, its ordinal ``pos``, its parent's, and ``fields`` (name -> path)."""
    rows = shredded.where(F.col("table_path") == table)
    return rows.select(
        key,
        F.try_element_at("ordinals", F.lit(-1)).alias("pos"),
        F.col("parent_ordinals").alias("parent_pos"),
        *[F.try_element_at("fields", F.lit(p)).alias(n) for n, p in fields.items()],
    )


class Items(NamedTuple):
    """What becomes a row of ``flat_items``: where in which record.

    ``path`` leads to an array (or to a single object in its place, position 0); None is
    the record itself (position -1). ``field`` names the field whose value is the item;
    with ``keys`` its keys are, and it may be an object or a list of key/value objects.
    """

    src: str
    record: str
    path: str | None
    field: str
    keys: bool


#: The characters of Unicode's White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _unkey(k: str) -> str:
    return k.replace("~1", "/").replace("~0", "~")


def items_of(rows: dict[tuple[str, tuple[int, ...]], dict[str, tuple[str | None, str]]], want: Items) -> list[tuple[int, str]]:
    """(pos, item) of one record's pivoted rows: each item once at a position, nulls and blanks left out."""
    got: dict[tuple[int, str], None] = {}

    def add(pos: int, item: str | None, value: str | None) -> None:
        if item is not None and value is not None and value.strip(WHITE) and item.strip(WHITE):
            got[pos, item.strip(WHITE).lower() if want.keys else item.strip(WHITE)] = None

    head, alone = want.path or "", -1 if want.path is None else 0
    for (table, at), fields in rows.items():
        if table == "":
            # the record's own fields, of which a single object in an array's place is a part
            pos, below, under = alone, head + want.field, ""
        elif want.path is not None and (table == f"{head}/*" or table.startswith(f"{head}/*/")):
            pos, below, under = at[0], want.field, table[len(head) + 2 :]
        elif table == f"{head}{want.field}/*":
            pos, below, under = alone, head + want.field, table
        else:
            continue
        if want.keys and under == f"{below}/*":
            add(pos, fields.get("/key", (None, ""))[0], fields.get("/value", (None, ""))[0])
        elif under == "":
            for path, (value, _) in fields.items():
                if want.keys and path.startswith(below + "/"):
                    add(pos, _unkey(path[len(below) + 1 :].split("/", 1)[0]), value)
                elif not want.keys and path == below:
                    add(pos, value, value)
    return list(got)


def flat_items(df: DataFrame, key: str, wanted: list[Items]) -> DataFrame:
    """src, ``key`` as text, pos and item of everything ``wanted`` in the JSON columns of ``df``.

    Every record is parsed once for all that is wanted of it, only the wanted paths are
    walked, and nothing is shuffled. A null or invalid record gives none; items that
    become equal at one position give one row; a null key is kept; equal rows each count.
    """
    records = list(dict.fromkeys(w.record for w in wanted))
    paths = {r: tuple(p for w in wanted if w.record == r for p in ((w.path or "") + w.field, (w.path or "") + "/*" + w.field)) for r in records}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            src: list[str] = []
            parent: list[str | None] = []
            pos: list[int] = []
            item: list[str] = []
            for r in records:
                for k, text in zip(pdf["k"], pdf[r], strict=True):
                    ok, value = parse(text)
                    if not ok:
                        continue
                    rows = pivot(triples(value, paths[r]))
                    for w in wanted:
                        if w.record == r:
                            for p, i in items_of(rows, w):
                                src.append(w.src)
                                parent.append(k)
                                pos.append(p)
                                item.append(i)
            out = pd.DataFrame({"src": src, "parent": parent, "item": item}, dtype="object")
            out.insert(2, "pos", pd.Series(pos, dtype="int32"))
            yield out

    src = df.select(F.col(key).cast("string").alias("k"), *[F.col(r) for r in records])
    return src.mapInPandas(run, "src string, parent string, pos int, item string")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Members of lineups and tags of raw_probe as flat rows with parent and position, each table read and parsed once."""
    lineups = spark.read.parquet(f"{sf_dir}/lineups.parquet").select("lineup_id", F.to_json("members").alias("members"))
    probe = spark.read.parquet(f"{sf_dir}/raw_probe.parquet").select("probe_id", F.to_json("tags").alias("tags"), "raw_json")
    members = flat_items(lineups, "lineup_id", [Items("member", "members", "", "/name", False)])
    tags = [Items("tag", "tags", None, "", True), Items("stream", "raw_json", "/streams", "/tags", True), Items("chapter", "raw_json", "/chapters", "/tags", True)]
    return members.unionByName(flat_items(probe, "probe_id", tags))
