"""Variant spellings of names: the spellings of one person or group come out linked.

Method. A spelling becomes a name-level vector of two weighted parts: the character
trigrams of its surname (or a group's own name), by idf, and what its given name, nickname
and initials give, which are the trigrams of the given name, its first letters and its
formal forms. The cosine of two names is the weighted sum of the parts' cosines
(``SURNAME`` and ``GIVEN``), and only pairs of that cosine are ever linked. Names of equal
given part are joined on the rarest trigrams of the other (prefix filter, exact, no cap in
place of a top-n); of those above the threshold a name takes the best known one's surname.
Then the names of one surname are grouped by average linkage of their cosines over the
sparse pairs that share a feature. Parsing does not link: it takes a name apart and
vetoes pairs (edits beyond one, contradicting given names or middle initials, other kinds
of groups). Two equally near clusters leave an initial unlinked.

Scale. Everything after the first step works on distinct spellings, later on distinct
keys, so a name with a third of all rows is one row. What meets in one task is the
distinct (given name, initials) keys of one surname, over sparse pairs.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacquer.llm.glyphs import consistent_form
from lacquer.operators.packed import split_packed
from lacquer.session import cut

# What stands for no name, nicknames, and the words for kinds of groups.
PLACEHOLDERS = frozenset(
    "unknown,unknown artist,unknown composer,various,various artists,various composers,various performers,va,v a,n a,na,none,null,anon,anonymous,trad,traditional,"
    "tba,tbd,diverse,misc,untitled,artist,composer,not available,no artist,compilation,soundtrack,ost,unbekannt,verschiedene,inconnu,divers,desconocido,varios".split(",")
)
NICKNAMES = {
    "al": "albert,alan,alfred", "alec": "alexander", "alex": "alexander,alexandra", "andy": "andrew,anders", "ben": "benjamin", "bert": "albert,robert,herbert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "katherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "dick": "richard", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "frank": "francis", "fred": "frederick,alfred", "freddie": "frederick",
    "gerry": "gerald", "greg": "gregory", "hal": "henry,harold", "hank": "henry", "harry": "henry,harold", "jack": "john", "jamie": "james", "jerry": "gerald", "jim": "james", "jimmy": "james", "jo": "josephine", "joe": "joseph",
    "johnny": "john", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "kitty": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "liz": "elizabeth", "lou": "louis,louise",
    "maggie": "margaret", "meg": "margaret", "mick": "michael", "mickey": "michael", "mike": "michael", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "pat": "patricia,patrick",
    "patty": "patricia", "patsy": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sandy": "alexander,alexandra",
    "steve": "stephen", "sue": "susannah,susan", "susie": "susannah,susan", "ted": "edward,theodore", "teddy": "edward,theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trish": "patricia", "vic": "victor,victoria", "vicky": "victoria", "vince": "vincent", "wally": "walter", "walt": "walter", "will": "william", "zach": "zachary", "zack": "zachary",
}
KINDS = {
    "duo": "duo", "trio": "trio", "3o": "trio", "3tet": "trio", "quartet": "quartet", "quartett": "quartet", "quartette": "quartet", "qrt": "quartet", "qt": "quartet", "4tet": "quartet",
    "quintet": "quintet", "quintett": "quintet", "qnt": "quintet", "5tet": "quintet", "sextet": "sextet", "sextett": "sextet", "sxt": "sextet", "6tet": "sextet", "septet": "septet", "septett": "septet", "7tet": "septet",
    "octet": "octet", "octett": "octet", "8tet": "octet", "nonet": "nonet", "9tet": "nonet", "ensemble": "ensemble", "ensembl": "ensemble", "ens": "ensemble", "orchestra": "orchestra", "orchestre": "orchestra",
    "orchester": "orchestra", "orch": "orchestra", "ork": "orchestra", "band": "band", "bigband": "big band", "singers": "singers", "sngrs": "singers", "choir": "choir", "chor": "choir", "players": "players", "plyrs": "players",
    "circle": "circle", "tr": "trio", "bb": "big band", "brothers": "brothers", "group": "group",
}
QUALIFIERS = {"big": "big", "chamber": "chamber", "chmbr": "chamber", "ch": "chamber", "cham": "chamber", "sons": "sons"}

_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFD", text.lower().translate(_SPECIAL))
    return unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c)))


def is_placeholder(text: str) -> bool:
    """Whether a spelling names nobody: blank, punctuation only, or a word for the unknown."""
    words = " ".join(re.findall(r"\w+", fold(text)))
    return words == "" or words in PLACEHOLDERS or words.isdigit()


def osa(a: str, b: str, limit: int = 2) -> int:
    """Edit distance with transpositions of neighbours, ``limit`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                v = min(v, prev2[j - 2] + 1)
            row[j] = v
        if min(row) > limit:
            return limit + 1
        prev2, prev = prev, row
    return min(prev[-1], limit + 1)


def parse_name(spelling: str) -> tuple[str, str, str, str, str, bool]:
    """(kind, first, last, initials, nickname, fixed) of a spelling.

    A group has its kind and its own name in ``last``. A person has kind ``person``;
    ``last`` is the surname and ``first`` the given name if ``fixed`` (written with a
    comma, or with one full word only), else the order of the two is to be found.
    ``initials`` are the letters written instead of or after the given name.
    """
    s = re.sub(r"\s*[(\[][^()\[\]]*[)\]]\s*$", "", spelling).strip() or spelling
    nick = " ".join(fold(x).strip() for x in re.findall(r'"([^"]+)"', s))
    body = re.sub(r'"[^"]*"', " ", s) if re.sub(r'"[^"]*"', "", s).strip() else s.replace('"', " ")
    flat = re.sub(r"\bb\.\s?b\.?(?=\W|$)", "bb", fold(body)) if re.search(r"(?i)\w{3,} b\.\s?b\.", body) else fold(body)
    the = re.sub(r",\s*the\s*$", "", flat)
    words = re.findall(r"[^\W_]+", the)
    kinds = [KINDS[w] for w in words if w in KINDS]
    if kinds and len(words) > 1:
        if len(kinds) > 1 and "group" in kinds:
            kinds.remove("group")
        quals = sorted({QUALIFIERS[w] for w in words if w in QUALIFIERS})
        core = " ".join(w for w in words if w not in KINDS and w not in QUALIFIERS and w != "the")
        return " ".join([*quals, *kinds]), "", core, "", "", True
    left, comma, right = the.partition(",")
    if comma and right.strip():
        given = re.findall(r"[^\W_]+", right)
        full = [w for w in given if len(w) > 1]
        inits = "".join(w for w in given if len(w) == 1)
        return "person", full[0] if full else "", " ".join(re.findall(r"[^\W_]+", left)), inits + "".join(w[0] for w in full[1:]), nick, True
    full = [w for w in words if len(w) > 1]
    inits = "".join(w for w in words if len(w) == 1)
    if len(full) < 2:
        return "person", "", full[0] if full else " ".join(words), inits if full else "", nick, True
    mid = "".join(w[0] for w in full[1:-1])
    led = len(words[0]) == 1  # "E. Maria Surname"
    if led:
        return "person", "", full[-1], inits + "".join(w[0] for w in full[:-1]), nick, True
    return "person", full[0], full[-1], inits + mid, nick, False


@lru_cache(maxsize=100_000)
def _formal(name: str) -> frozenset[str]:
    return frozenset([name, *NICKNAMES.get(name, "").split(",")]) - {""}


def same_given(a: str, b: str) -> bool:
    """Whether two full given names are equal or one is a nickname of the other."""
    return bool(_formal(a) & _formal(b)) and (a == b or a in _formal(b) or b in _formal(a) or len(_formal(a) & _formal(b)) > 0)


#: Weights of the parts of a name in its cosine, and the cosine from which names are linked.
SURNAME, GIVEN, LEAST = 0.6, 0.4, 0.65
#: A given name is established if it has so many surnames, unless a name one edit from it has ``COMMONER`` times as many.
SURNAMES, COMMONER = 4, 4
#: Initials that are so much nearer to one of two clusters are linked to it.
NEAR = 0.06
#: Weights of the features of a given part: a trigram, a first letter, a formal name, a middle initial.
_TRIGRAM, _LETTER, _FORM, _MIDDLE = 0.5, 1.0, 1.5, 1.0


def given_vector(key: tuple) -> dict[str, float]:
    """The features of a key (given, initials, nickname, established), of unit length; empty if it has none."""
    given, inits, nick, _ = key
    v: dict[str, float] = {}
    forms = set().union(*(_formal(x) for x in (given, *nick.split()) if x))
    if given:
        v |= dict.fromkeys(_grams(given), _TRIGRAM)
    v |= {f"={f}": _FORM for f in forms} | {f"^{f[0]}": _LETTER for f in forms}
    if not given and inits:
        v[f"^{inits[0]}"] = _LETTER
    v |= {f"+{x}": _MIDDLE for x in (inits if given else inits[1:])}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {f: x / norm for f, x in v.items()}


def vetoed(a: tuple, b: tuple) -> bool:
    """Whether two keys of one surname contradict each other."""
    ga, ia, na, ea = a
    gb, ib, nb, eb = b
    ma, mb = (ia if ga else ia[1:]), (ib if gb else ib[1:])
    if ma and mb and ma[0] != mb[0]:
        return True
    if ga and gb:
        if ga == gb or same_given(ga, gb) or na == gb or nb == ga:
            return False
        if (ea and eb) or min(len(ga), len(gb)) <= 2:
            return True
        return osa(ga, gb, 1) > 1 and not any(osa(x, y, 1) <= 1 for x in _formal(ga) | set(na.split()) for y in _formal(gb) | set(nb.split()))
    if not (ga or ia) or not (gb or ib):
        return True
    if ga or gb:
        g, i = (ga, ib) if ga else (gb, ia)
        return all(f[0] != i[0] for f in _formal(g))
    return ia[0] != ib[0]


def name_cosines(keys: list[tuple]) -> dict[tuple[int, int], float]:
    """Cosines of the names of one surname that share a feature and aren't vetoed, by index (smaller first)."""
    at: dict[str, list[tuple[int, float]]] = {}
    dots: dict[tuple[int, int], float] = {}
    for i, k in enumerate(keys):
        for f, x in given_vector(k).items():
            for j, y in at.setdefault(f, []):
                dots[j, i] = dots.get((j, i), 0.0) + x * y
            at[f].append((i, x))
    return {p: SURNAME + GIVEN * c for p, c in dots.items() if not vetoed(keys[p[0]], keys[p[1]])}


def average_linkage(keys: list[tuple], least: float = LEAST, near: float = NEAR) -> list[int]:
    """Cluster number of each key; merges the nearest clusters while their mean cosine is ``least`` or more.

    Pairs that share nothing or are vetoed are never averaged away: clusters merge only
    if all their pairs have a cosine. A cluster of initials only that is about as near
    (``near``) to two clusters which contradict each other stays alone. Ties go to the
    smaller numbers.
    """
    links: dict[int, dict[int, tuple[float, int]]] = {i: {} for i in range(len(keys))}
    for (i, j), c in name_cosines(keys).items():
        links[i][j] = links[j][i] = (c, 1)
    members = {i: [i] for i in range(len(keys))}
    named = {i: bool(keys[i][0]) for i in members}

    def mean(a: int, b: int) -> float:
        total, n = links[a].get(b, (0.0, 0))
        return total / n if n and n == len(members[a]) * len(members[b]) else -1.0

    heap = [(-mean(a, b), a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(heap)
    while heap:
        best, a, b = heapq.heappop(heap)
        best = -best
        if best < least:
            break
        if a not in members or b not in members or mean(a, b) != best:
            continue
        unclear = None
        for x, y in ((a, b), (b, a)):
            if not named[x] and named[y]:
                for z in links[x]:
                    if z not in (x, y) and named[z] and least <= (other := mean(x, z)) and best - other < near and mean(y, z) < 0:
                        unclear = x
        if unclear is not None:
            for z in [z for z in links[unclear] if named[z]]:
                del links[unclear][z], links[z][unclear]
            continue
        members[a] += members.pop(b)
        named[a] = named[a] or named[b]
        for c, (total, n) in links.pop(b).items():
            del links[c][b]
            if c != a:
                t, m = links[a].get(c, (0.0, 0))
                links[a][c] = links[c][a] = (t + total, m + n)
        for c in links[a]:
            if (m := mean(a, c)) >= least:
                heapq.heappush(heap, (-m, min(a, c), max(a, c)))
    out = [0] * len(keys)
    for c, ms in members.items():
        for m in ms:
            out[m] = c
    return out


# ------------------------------------------------------------- similarity join of words


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return sorted({w[i : i + 3] for i in range(len(w) - 2)}) if len(w) > 2 else [w]


def similar_names(names: DataFrame, word: str = "word", by: list[str] | None = None, threshold: float = 0.25, edits: int = 1) -> DataFrame:
    """Pairs (by, a, b) of distinct words of one ``by``, a < b, with trigram cosine >= threshold and edit distance <= edits.

    Weights are the square root of idf over the distinct words (a typing error makes rare
    grams, which full idf would weigh too much); vectors have unit length. Only the
    prefix of a vector (rarest grams first) whose rest is no shorter than ``threshold``
    is joined, so no pair is lost, and only words whose lengths differ by at most
    ``edits`` meet. Of those only pairs within twice the edits by plain edit distance
    (a transposition is two plain edits), counted inside the join, are weighed against
    each other's vectors. Empty words have no pair.
    """
    by = by or []
    w = names.select(F.col(word).alias("w")).where("w <> ''").distinct()

    @F.pandas_udf("array<string>")
    def grams(s: pd.Series) -> pd.Series:
        return s.map(_grams)

    long = w.select("w", F.explode(grams("w")).alias("g"))
    df = long.groupBy("g").agg(F.count("*").alias("df"))
    total = w.count()
    weight = F.sqrt(F.log1p(F.lit(float(total)) / F.col("df")))
    vec = cut(long.join(df, "g").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("df", "g", weight.alias("x")))).alias("v")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])
    ahead = F.aggregate(
        "v",
        F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<string>)").alias("gs")),
        lambda acc, e: F.struct(
            (acc["s"] + e["x"] * e["x"]).alias("s"),
            F.when(F.col("n2") - acc["s"] >= F.col("n2") * (threshold**2 - 1e-9), F.concat(acc["gs"], F.array(e["g"]))).otherwise(acc["gs"]).alias("gs"),
        ),
    )["gs"]
    ahead = vec.withColumn("n2", norm2).select("w", ahead.alias("gs"))
    own = names.select(*by, F.col(word).alias("w")).where("w <> ''").distinct().join(ahead, "w") if by else ahead
    post = own.select(*by, "w", F.length("w").alias("n"), F.explode("gs").alias("g"))
    left = post.select(*by, "g", F.col("w").alias("a"), F.explode(F.sequence(F.col("n"), F.col("n") + edits)).alias("n"))
    right = post.select(*by, "g", "n", F.col("w").alias("b"))
    near = (F.col("a") != F.col("b")) & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 2 * edits) >= 0)
    met = left.join(right, [*by, "g", "n"]).where(near).select(*by, "a", "b").distinct()
    both = met.join(vec.select(F.col("w").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("w").alias("b"), F.col("v").alias("vb")), "b")
    types = dict(met.dtypes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cosines = []
            for a, va, b, vb in zip(pdf["a"], pdf["va"], pdf["b"], pdf["vb"], strict=True):
                cos = -1.0
                if osa(a, b, edits) <= edits:
                    x, y = {e["g"]: e["x"] for e in va}, {e["g"]: e["x"] for e in vb}
                    cos = sum(q * y[g] for g, q in x.items() if g in y) / np.sqrt(sum(q * q for q in x.values()) * sum(q * q for q in y.values()))
                cosines.append(float(cos))
            out = pdf[by].assign(a=np.minimum(pdf["a"], pdf["b"]), b=np.maximum(pdf["a"], pdf["b"]), cosine=cosines)
            yield out[out["cosine"] >= threshold]

    return both.mapInPandas(verify, "".join(f"{c} {types[c]}, " for c in by) + "a string, b string, cosine double")


# ------------------------------------------------------------------------ the operator

_PARSED = "kind string, first string, last string, inits string, nick string, fixed boolean"


def slips(counts: DataFrame) -> DataFrame:
    """The given names ``w`` (of SURNAMES or more in ``as_given``) that are a typing error of a name COMMONER times as common.

    The typing errors of a common name grow with the data as the name does, so a count alone
    does not tell them from names. Words within one edit share themselves without a letter;
    they meet on that. Names of the list of nicknames are none.
    """
    known = sorted({*NICKNAMES, *(f for v in NICKNAMES.values() for f in v.split(","))})
    less = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))
    v = counts.where(F.col("as_given") >= SURNAMES).select("w", "as_given", F.explode(F.array_distinct(F.concat(F.array("w"), less))).alias("v"))
    to = v.select("v", F.col("w").alias("to"), F.col("as_given").alias("to_given"))
    met = v.where(~F.col("w").isin(known)).join(to, "v").where(F.col("to_given") >= COMMONER * F.col("as_given")).select("w", "to").distinct()

    @F.pandas_udf("boolean")
    def one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, 1) <= 1 for x, y in zip(a, b, strict=True)], dtype=bool)

    return met.where(one_edit("w", "to")).select("w").distinct()


def link_names(spellings: DataFrame, col: str = "name", threshold: float = 0.55) -> DataFrame:
    """Each distinct spelling that is a name, with the ``entity`` it belongs to.

    Null and blank spellings and placeholders are no names. A spelling that resembles no
    other is an entity alone. Repeated rows count once; extra columns are ignored.
    """
    distinct = spellings.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(x, *parse_name(x)) for x in pdf["name"] if not is_placeholder(x)]
            yield pd.DataFrame(out, columns=["name", "kind", "first", "last", "inits", "nick", "fixed"])

    parsed = cut(distinct.mapInPandas(parse, "name string, " + _PARSED))

    # which of two words is the given name: it meets more partners as one than as a surname
    people = parsed.where("kind = 'person' and first <> ''")
    roles = people.select(F.explode(F.array(F.struct(F.col("first").alias("w"), F.col("last").alias("p"), F.lit(1).alias("r")), F.struct(F.col("last").alias("w"), F.col("first").alias("p"), F.lit(-1).alias("r")))).alias("x"))
    score = cut(roles.select("x.w", "x.p", "x.r").distinct().groupBy("w").agg(F.sum("r").alias("score"), F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).alias("as_given")))
    score = score.join(slips(score).withColumn("slip", F.lit(True)), "w", "left").withColumn("sure", (F.col("as_given") >= SURNAMES) & F.isnull("slip"))
    first = score.select(F.col("w").alias("first"), F.col("score").alias("fs"), F.col("sure").alias("fe"))
    last = score.select(F.col("w").alias("last"), F.col("score").alias("ls"), F.col("as_given").alias("lg"), F.col("sure").alias("le"))
    scored = parsed.join(first, "first", "left").join(last, "last", "left")
    swap = ~F.col("fixed") & (F.col("ls") > F.col("fs")) & (F.col("lg") >= 2)
    keyed = cut(scored.select(
        "name",
        "kind",
        F.when(swap, F.col("first")).otherwise(F.col("last")).alias("word"),
        F.when(swap, F.col("last")).otherwise(F.col("first")).alias("given"),
        "inits",
        "nick",
        F.coalesce(F.when(swap, F.col("le")).otherwise(F.col("fe")), F.lit(False)).alias("established"),
    ))

    # names whose other part is a typing error of a better known one: their given parts are equal, so
    # the cosine of the names is SURNAME times that of the words plus GIVEN
    edges = cut(similar_names(keyed.where("kind <> 'person' or given <> ''"), "word", ["kind", "given"], (threshold - GIVEN) / SURNAME))
    support = keyed.groupBy("word").agg(F.count("*").alias("support"))
    both = edges.select("kind", "given", F.col("a").alias("word"), F.col("b").alias("to")).unionByName(edges.select("kind", "given", F.col("b").alias("word"), F.col("a").alias("to")))
    moves = (
        both.join(support, "word")
        .join(support.select(F.col("word").alias("to"), F.col("support").alias("to_support")), "to")
        .where((F.col("to_support") > F.col("support")) | ((F.col("to_support") == F.col("support")) & (F.col("to") < F.col("word"))))
        .groupBy("kind", "word", "given")
        .agg(F.max_by("to", F.struct("to_support", "to")).alias("home"))
    )
    homed = cut(keyed.join(moves, ["kind", "word", "given"], "left").withColumn("home", F.coalesce("home", "word")).drop("word"))

    groups = homed.where("kind <> 'person'").select("name", F.concat_ws("|", "kind", "home").alias("entity"))
    persons = homed.where("kind = 'person'").drop("kind")
    keys = persons.groupBy("home", "given", "inits", "nick").agg(F.max("established").alias("established"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["given", "inits", "nick"]).reset_index(drop=True)
        ids = average_linkage(list(zip(pdf["given"], pdf["inits"], pdf["nick"], pdf["established"], strict=True)))
        return pdf[["home", "given", "inits", "nick"]].assign(cluster=np.array(ids, dtype="int32"))

    # few bytes but much work: keep the partitions that a coalescing by size would merge
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clusters = keys.repartition(parts, "home").groupBy("home").applyInPandas(cluster, "home string, given string, inits string, nick string, cluster int")
    linked = persons.join(clusters, ["home", "given", "inits", "nick"]).select("name", F.concat_ws("|", F.lit("person"), "home", F.col("cluster").cast("string")).alias("entity"))
    return groups.unionByName(linked)


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of each two spellings of one entity, name_a < name_b in code point order."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def personnel_names(tracks: DataFrame) -> DataFrame:
    """The distinct values of tracks.personnel as p7 splits them, or the whole field, each without a bracketed part at its end."""
    shelf = tracks.select("personnel", F.substring_index("path", "/", 1).alias("shelf"))
    values = split_packed(shelf, ["shelf"], ["personnel"], "shelf", at_least=1).select("val").distinct()
    return values.select(F.regexp_replace("val", r"\s*[(\[][^()\[\]]*[)\]]\s*$", "").alias("name")).distinct()


def _spellings(spark, sf_dir: str) -> DataFrame:
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet")
    releases = spark.read.parquet(f"{sf_dir}/releases.parquet")
    composers = consistent_form(tracks.select("composer").distinct(), ["composer"], ["composer"]).select(F.col("fixed").alias("name"))
    return (
        composers.unionByName(tracks.select(F.col("artist_tag").alias("name")).distinct())
        .unionByName(releases.select(F.col("album_artist").alias("name")).distinct())
        .unionByName(personnel_names(tracks))
    )


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one person or group in the four name fields."""
    return variant_pairs(link_names(_spellings(spark, sf_dir)))


def p4_entities(spark, sf_dir: str) -> DataFrame:
    """Every spelling that is a name with its entity (named by its first spelling) and how many other spellings it is linked to."""
    linked = link_names(_spellings(spark, sf_dir))
    facts = linked.groupBy("entity").agg(F.min("name").alias("first_spelling"), (F.count("*") - 1).alias("links"))
    return linked.join(facts, "entity").select("name", "first_spelling", "links")
