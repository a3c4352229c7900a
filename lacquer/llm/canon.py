"""Mapping free-entered values to a reference list, unmatched values reported.

Method. The reference entries' forms (canonical value, code, known other words) are the
nodes of a BK-tree under edit distance, a true metric, so the triangle inequality prunes
whole subtrees and still returns every form within the threshold. The nearest accepted
form wins; an exact check of the parts (surname and given name, instrument words)
follows, in which two neighbours exchanged count as one edit.

Scale. A reference list up to ``MAX_BROADCAST`` entries (its size is checked) goes to every
task and the records are mapped in one narrow pass that looks up each distinct value of a
batch once. A longer list is sharded: every shard has its own trees, distinct values meet
every shard in salted groups, and the nearest hits of the shards are merged to the answer
that one tree over the whole list gives.
"""

from __future__ import annotations

import re
from itertools import product
from collections.abc import Callable, Iterable, Iterator, Set

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacquer.llm.glyphs import core, plain_form, repair_text
from lacquer.llm.names import fold, is_placeholder, osa, parse_name, same_given
from lacquer.session import cut

#: Reference entries that may be sent to every task; one takes well under 1 kB with its forms.
MAX_BROADCAST = 50_000

# Names in other languages, usual abbreviations and other names of instruments, kinds of a genre. Misspellings
# are none of these: they are what the tree is for. The words of a name of several are put in by rule, joined and apart.
WORD_FORMS = {
    "saxophone": "sax saxophon", "alto": "a alt", "tenor": "t ten", "soprano": "s sop sopr sopran", "baritone": "b bs bar bari bariton", "bass": "b bs basse bajo bas",
    "clarinet": "cl clar clari clt klar klarinette clarinette clarinete", "guitar": "gt gtr guit git gitarre guitare guitarra chitarra", "piano": "pn pno klavier klav",
    "electric": "e el elec electr elektrisches electrique electrico", "acoustic": "ac", "french": "fr f frn", "horn": "hrn", "double": "dbl",
}
INSTRUMENT_WORDS = {
    "alto saxophone": "saxophone alto mib",
    "flute": "flauta,flt,querflote,concert flute,flauto",
    "trumpet": "tpt,trpt,trp,trompete,trompette,trompeta,tromba,tr",
    "trombone": "tbn,trb,trbn,posaune,slide trombone,tromb,pos",
    "french horn": "waldhorn,cor d harmonie,trompa,horn f,cor,hrn,corno",
    "piano": "pf,acoustic piano,grand piano,pianoforte,flugel,piano a queue,upright piano",
    "electric piano": "rhodes,fender rhodes,wurlitzer",
    "organ": "orgel,orgue,hammond,hammond organ,pipe organ,b3,hammond b3,drawbar organ,electric organ,church organ",
    "double bass": "acoustic bass,upright bass,string bass,kontrabass,contrebasse,contrabass,contrabajo,bass violin,standup bass,db,upright,stand up bass,bass fiddle,bass",
    "bass guitar": "electric bass,electric bass guitar,fender bass",
    "guitar": "acoustic guitar,electric guitar,rhythm guitar,lead guitar",
    "drums": "dr,drum set,drum kit,drs,schlagzeug,batterie,bateria,trap set,traps,batt,kit",
    "percussion": "schlagwerk,hand percussion,percuss,congas,bongos",
    "vibraphone": "vibes,vbs,vibraharp,vibrafon,vibrafono,vbr,vph",
    "violin": "vl,fiddle,geige,viol,vn,vio",
    "cello": "violoncello,vcl,cel,violoncelle,violonchelo,vlc,clo",
    "voice": "vocal,vocals,vox,singer,gesang,chant,vo,lead vocals,voz,vocalist,singing,voix,stimme,sung",
}
GENRE_WORDS = {
    "Classical": "classic,klassik,classique,clasica,chamber,classical music,symphonic,baroque",
    "Jazz": "bebop,bop,modern jazz,jazz music,cool jazz,free jazz,hard bop,swing",
    "Rock": "rock n roll,rock roll,rock and roll,rock n,rock music,hard rock,classic rock,rock pop rock",
    "Electronic": "elektronisch,electro,techno,ambient,electronic music,edm,idm,synth",
    "Hip-Hop": "rap,hip hop rap,hip hop music",
    "Folk": "folk music,folk trad,folklore,volksmusik,folk song,trad folk",
    "Blues": "blues music,delta blues,electric blues",
    "World": "world music,latin,weltmusik,musique du monde,world latin",
    "Pop": "pop music,popular,popmusik",
    "Soundtrack": "ost,ost soundtrack,film score,filmmusik,film music,score,original soundtrack",
    "Spoken Word": "spoken,audiobook,speech,horbuch",
    "Gospel": "gospel choir,gospel music",
}
#: Words that say nothing about which instrument it is (fixed values).
_FILLER = frozenset("the,a,an,and,solo,lead,first,second,1st,2nd,in,bb,eb,of,misc,various".split(","))


def levenshtein(a: str, b: str) -> int:
    """Edit distance (a metric), by bit-parallel columns."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score


class BKTree:
    """Forms under a true metric; equal forms share a node and keep all their payloads."""

    def __init__(self, metric: Callable[[str, str], int] = levenshtein):
        self.metric = metric
        self.root: tuple[str, list, dict] | None = None

    def add(self, form: str, payload) -> None:
        if self.root is None:
            self.root = (form, [payload], {})
            return
        node = self.root
        while True:
            dist = self.metric(form, node[0])
            if dist == 0:
                node[1].append(payload)
                return
            if dist not in node[2]:
                node[2][dist] = (form, [payload], {})
                return
            node = node[2][dist]

    def within(self, form: str, most: int) -> list[tuple[int, str, object]]:
        """Every (distance, form, payload) within ``most``, nearest first, ties by form and payload."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            f, payloads, kids = todo.pop()
            dist = self.metric(form, f)
            if dist <= most:
                out += [(dist, f, p) for p in payloads]
            todo += [n for edge, n in kids.items() if dist - most <= edge <= dist + most]
        return sorted(out, key=lambda x: (x[0], x[1], str(x[2])))


def word_form(text: str) -> str:
    """Folded words in order, joined by a space."""
    return " ".join(re.findall(r"[^\W_]+", fold(text)))


def _allowed(*forms: str) -> int:
    """Edits allowed between forms, by the longest."""
    n = max(map(len, forms))
    return 0 if n < 4 else 1 if n < 9 else 2


#: What one attempt of a matcher found: which attempt, and the nearest (edits, id).
Attempt = tuple[int, list[tuple[int, int]]]


def resolve(attempts: Iterable[Attempt], people: bool) -> int:
    """The id of the first attempt that decides, -1 if none does.

    Of people the nearest wins, the smaller id on ties; an attempt at a word decides if
    one entry only is nearest.
    """
    for _, hits in attempts:
        if hits:
            d, id_ = min(hits)
            if people or {i for e, i in hits if e == d} == {id_}:
                return id_
    return -1


def written(name: str, whole: bool) -> set[str]:
    """The forms of a name: its words with their other forms, apart and joined; of an other name (not ``whole``) of one word only itself."""
    words = word_form(name).split()
    if len(words) == 1 and not whole or len(words) > 4:
        return {" ".join(words)}
    ways = list(product(*[[w, *WORD_FORMS.get(w, "").split()] for w in words]))
    return {" ".join(ws) for ws in ways} | {"".join(ws) for ws in ways}


class Matcher:
    """Reference entries of one kind with their forms in a tree.

    ``entries`` are (id, canonical value, code); ``words`` other words by canonical value.
    ``people`` entries are names ("Surname, Given").
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], words: dict[str, str] | None = None, people: bool = False):
        self.people, self.tree, self.canon = people, BKTree(), {c for _, c, _ in entries}
        self.keys: dict[int, tuple[str, str]] = {}
        self.given: set[str] = set()
        self.known: set[str] = set()
        self.asked: dict[str, list[tuple[int, int]]] = {}
        for id_, canon, code in entries:
            if people:
                _, first, last, _, _, _ = parse_name(canon)
                self.keys[id_] = (last, first)
                self.given.add(first)
                self.known |= {core(w) for w in canon.split()}
                self.tree.add(last, id_)
                continue
            others = [x for x in (words or {}).get(canon, "").split(",") if x]
            forms = {canon: written(canon, True)} | {x: written(x, False) for x in others} | ({code: {word_form(code)}} if code else {})
            for f in sorted(set().union(*forms.values()) - {""}):
                self.tree.add(f, id_)
                if " " in f:
                    self.tree.add(" ".join(sorted(f.split())), id_)

    def find(self, value: str) -> int:
        """The id of the entry meant, -1 if none is."""
        return resolve(self.attempts(value), self.people)

    def attempts(self, value: str, taken: frozenset[str] | None = None) -> Iterator[Attempt]:
        """The attempts at a value in their order. ``taken`` are given names of other entries, those of this matcher if None.

        A list that is cut into shards gives the same attempts piece by piece: of each the
        nearest hits of all shards are those of the whole.
        """
        if self.people:
            yield 0, self._person(value, self.given if taken is None else taken)
        else:
            yield from self._word(value)

    # people: surname and given name are checked apart
    def _person(self, value: str, taken: Set[str]) -> list[tuple[int, int]]:
        out = []
        for surname, given, inits, nick in self.ways(value):
            for ds, id_ in self._surnames(surname):
                g = self.keys[id_][1]
                if given:
                    dg = self._given(given, nick, g, taken)
                    if dg is not None and ds + dg <= 1:
                        out.append((ds + dg, id_))
                elif inits[0] == g[:1]:
                    out.append((ds, id_))
        return out

    def ways(self, value: str) -> list[tuple[str, str, str, str]]:
        """(surname, given, initials, nickname) of each way to read a name."""
        text = repair_text(plain_form(value), self.known)
        if is_placeholder(text):
            return []
        kind, first, last, inits, nick, fixed = parse_name(text)
        if kind != "person" or not last:
            return []
        both = [(last, first)] if fixed or not first else [(last, first), (first, last)]
        return [(s, g, inits, nick) for s, g in both if g or inits]

    def _surnames(self, word: str) -> list[tuple[int, int]]:
        """(edits, id) of the entries whose surname is at most one edit away."""
        got = self.asked.get(word)
        if got is None:
            near = ((osa(word, f, 1), id_) for _, f, id_ in self.tree.within(word, 2))
            got = self.asked[word] = [(d, id_) for d, id_ in near if d <= 1]
        return got

    def _given(self, given: str, nick: str, entry: str, taken: Set[str]) -> int | None:
        if given == entry:
            return 0
        if same_given(given, entry) or nick == entry:
            return 0
        if given in taken:
            return None
        return 1 if osa(given, entry, 1) == 1 else None

    # words: the whole, its parts, and the parts without brackets
    def _word(self, value: str) -> Iterator[Attempt]:
        text = plain_form(value)
        whole = word_form(text)
        if whole == "":
            return
        plain = [whole, " ".join(sorted(whole.split()))]
        bare = re.sub(r"[(\[][^()\[\]]*[)\]]", " ", text)
        bare = re.sub(r"(?i)\bin\s+[a-h](?:[\s-]?(?:flat|sharp)|[b♭♯#])?\s*$", " ", bare)
        inner = " ".join(re.findall(r"[(\[]([^()\[\]]*)[)\]]", text))
        forms = []
        for t in [bare, inner, *re.split(r"[/;|]|\s-\s|,", bare), *re.split(r"[/;|]|\s-\s|,", text)]:
            words = [w for w in word_form(t).split() if w not in _FILLER]
            if words and (f := " ".join(words)) not in forms:
                forms += [f, " ".join(sorted(words))]
        tries = [*plain, *forms]
        for n, f in enumerate(tries):
            yield n, self._near(f, 0)
        for n, f in enumerate(tries, len(tries)):
            yield n, self._near(f, _allowed(f + "x"))

    def _near(self, form: str, most: int) -> list[tuple[int, int]]:
        """The nearest entries within ``most`` edits, two neighbours exchanged being one."""
        near = ((min(d, osa(form, f, most)), f, id_) for d, f, id_ in self.tree.within(form, 2 * most))
        got = [(d, id_) for d, f, id_ in near if d <= min(most, _allowed(f, form))]
        return [x for x in got if x[0] == min(got)[0]]


#: Other words of the kinds of reference values.
WORDS = {"instrument": INSTRUMENT_WORDS, "genre": GENRE_WORDS}


def matchers(rows: Iterable) -> dict[str, Matcher]:
    """A matcher for each kind of reference rows (ref_id, kind, canon, code)."""
    by: dict[str, list[tuple[int, str, str | None]]] = {}
    for r in sorted(rows, key=lambda r: r["ref_id"]):
        by.setdefault(r["kind"], []).append((r["ref_id"], r["canon"], r["code"]))
    return {k: Matcher(v, WORDS.get(k), k == "composer") for k, v in by.items()}


def map_reference(records: DataFrame, value: str, kind: str, reference: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``records`` with ``ref_id`` by a reference list of any length: broadcast up to ``most`` entries, sharded beyond.

    Both ways give the same: see :func:`map_to_reference` and :func:`map_sharded`.
    """
    entries = reference.select("ref_id", "kind", "canon", "code").where(F.col("canon").isNotNull())
    rows = entries.limit(most + 1).collect()
    return map_to_reference(records, value, kind, matchers(rows)) if len(rows) <= most else map_sharded(records, value, kind, entries)


def map_to_reference(records: DataFrame, value: str, kind: str, known: dict[str, Matcher]) -> DataFrame:
    """``records`` with ``ref_id``, for non-blank values that are no canonical value themselves.

    ``kind`` is the column that names the reference kind. Null and blank values give no
    row; a value with no entry gives -1; repeated rows each come out; of two entries
    equally near none is chosen. Other columns are passed on as they are.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("ref_id", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int | None] = {}
        for pdf in batches:
            if len(seen) > 200_000:
                seen.clear()
            ids = []
            for k, v in zip(pdf[kind], pdf[value], strict=True):
                got = seen.get((k, v), 0)
                if got == 0:
                    m = known.get(k)
                    got = seen[k, v] = None if v is None or not plain_form(v).strip() or (m and v in m.canon) else m.find(v) if m else -1
                ids.append(got)
            out = pdf.assign(ref_id=pd.array(ids, dtype="Int64"))
            yield out[out["ref_id"].notna()]

    return records.mapInPandas(run, schema)


def map_sharded(records: DataFrame, value: str, kind: str, entries: DataFrame, shards: int = 32, salts: int = 32) -> DataFrame:
    """:func:`map_to_reference` for lists too long to send to every task.

    Each shard of the entries holds its own trees; the distinct values of a kind meet every
    shard in ``salts`` groups and bring along which of their words are given names of
    entries. The nearest hits of each attempt are merged over the shards and resolved as a
    single matcher would; a value has few, whatever the number of entries.
    """
    asked = records.select(F.col(kind).alias("kind"), F.col(value).alias("value")).where(F.col("kind").isNotNull() & (F.trim("value") != "")).distinct()
    exact = entries.select("kind", F.col("canon").alias("value")).distinct()
    asked = cut(asked.join(exact, ["kind", "value"], "left_anti"))
    blank = Matcher([], people=True)

    @F.pandas_udf("array<string>")
    def givens(names: pd.Series) -> pd.Series:
        return names.map(lambda x: sorted({g for _, g, _, _ in blank.ways(x) if g}))

    people = lambda df, c: df.where("kind = 'composer'").select("kind", c, F.explode(givens(c)).alias("g"))
    taken = people(asked, "value").join(people(entries, "canon").select("g").distinct(), "g").groupBy("kind", "value").agg(F.collect_set("g").alias("taken"))
    v = asked.join(taken, ["kind", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    f = entries.withColumn("shard", F.pmod(F.xxhash64("kind", "canon"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = matchers(right.to_dict("records"))
        out = []
        for k, x, t in zip(left["kind"], left["value"], left["taken"], strict=True):
            if k in known and plain_form(x).strip():
                own = frozenset(t) if t is not None else frozenset()
                out += [(k, x, n, d, i) for n, hits in known[k].attempts(x, own) for d, i in hits]
        return pd.DataFrame(out, columns=["kind", "value", "attempt", "edits", "ref_id"])

    hits = v.groupBy("shard", "salt").cogroup(f.groupBy("shard", "salt")).applyInPandas(run, "kind string, value string, attempt int, edits int, ref_id bigint")
    near = hits.groupBy("kind", "value", "attempt").agg(F.min("edits").alias("d"), F.min_by(F.struct("ref_id"), F.struct("edits", "ref_id"))["ref_id"].alias("i"), F.collect_set(F.struct("edits", "ref_id")).alias("hs"))
    one = F.size(F.filter("hs", lambda h: h["edits"] == F.col("d"))) == 1
    best = near.where(one | (F.col("kind") == "composer")).groupBy("kind", "value").agg(F.min_by("i", "attempt").alias("i"))
    mapped = asked.join(best, ["kind", "value"], "left").select(F.col("kind").alias("_k"), F.col("value").alias("_v"), F.coalesce("i", F.lit(-1)).cast("bigint").alias("ref_id"))
    out = records.join(mapped, (F.col(kind) == F.col("_k")) & (F.col(value) == F.col("_v")), "inner").drop("_k", "_v")
    return out.where(F.length(F.regexp_replace(value, r"(?U)[\s\p{Cf}\p{Z}]+", "")) > 0)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The entry of every composer, instrument and genre that isn't a canonical value."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    composers = read("tracks").select(F.lit("composer").alias("field"), F.col("row_id").cast("string").alias("rec"), F.lit(-1).alias("pos"), F.col("composer").alias("value"), F.lit("composer").alias("kind"))
    instruments = read("lineups").select("lineup_id", F.posexplode("members").alias("pos", "m")).select(F.lit("instrument").alias("field"), F.col("lineup_id").alias("rec"), "pos", F.col("m.instrument").alias("value"), F.lit("instrument").alias("kind"))
    genres = read("releases").select(F.lit("genre_primary").alias("field"), F.col("release_id").alias("rec"), F.lit(-1).alias("pos"), F.col("genre_primary").alias("value"), F.lit("genre").alias("kind"))
    records = composers.unionByName(instruments).unionByName(genres).where(F.trim("value") != "")
    return map_reference(records, "value", "kind", read("ref_values")).select("field", "rec", "pos", "ref_id")
