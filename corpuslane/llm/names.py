"""Problem 4: variant spellings of persons and journals.

Method: spellings are parsed to sorted tokens, blocked by the tokens' phonetic codes (and, for typing
errors that change a code, by the ends of the tokens), compared by Jaro-Winkler and a nickname
table, and clustered by connected components of the accepted pairs. Initials and abbreviations join a
cluster only if it is the one cluster that they can stand for.

Since a slip may be in the surname or in the given name, but not in both, each block key holds one of
the two as it is and only a code of the other: a frequent surname is split by its bearers' given
names, a frequent given name by the surnames. Initials meet full names only, never each other.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.llm.forest import spanning_forest
from corpuslane.session import materialize

# Common given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander lex", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony ant",
    "benjamin": "ben benny benji", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "christine": "chris chrissy tina",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donnie",
    "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth betty eliza lisa lizzie libby bess", "eugene": "gene", "francisco": "paco pancho",
    "franziska": "franzi ziska", "frederick": "fred freddie freddy fritz", "gabriella": "gabi gabby gaby", "giovanni": "gianni nanni vanni",
    "guillermo": "memo guille", "gregory": "greg", "henry": "harry hank hal", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josé": "pepe", "katherine": "kate kathy katie kathie kat kit",
    "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge madge", "matthew": "matt matty",
    "michael": "mike mick mickey mikey", "mikhail": "misha", "nicholas": "nick nico nicky", "patricia": "pat patty tricia trish", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby bert robbie",
    "ronald": "ron ronnie", "samuel": "sam sammy", "samantha": "sam", "sanjay": "sanju", "stephen": "steve stevie", "steven": "steve", "susan": "sue susie suzy",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "tomas": "tom", "ulrike": "uli ulli rike", "victoria": "vicky tori vic vicki",
    "vladimir": "vova volodya", "wilhelm": "willi willy wim", "william": "bill will billy willie liam", "zachary": "zach zack", "jürgen": "jogi",
    "dmitri": "dima mitya", "maria": "mia", "ivan": "vanya", "aleksandr": "sasha", "nikolai": "kolya", "sergei": "seryozha", "ekaterina": "katya",
}

_DEGREES = frozenset("md phd dr prof msc bsc mph rn do dds mbbs frcp jr sr ii iii esq facp facs pharmd dphil mbchb ba ma".split())
_GROUP = re.compile(r"\b(?:stud(?:y|ies)|group|groups|consortium|investigators?|collaborat\w+|committee|network|trialists?|team|society|association|initiative|registry|working|project|university|institute)\b")
_ET_AL = re.compile(r"^\W*et\.?\s*al\W*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'"})


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).translate(_PLAIN)


_SHORT: dict[str, frozenset[str]] = {}
for _full, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _SHORT[_n] = _SHORT.get(_n, frozenset()) | {fold(_full)}


def full_names(given: str) -> frozenset[str]:
    """The given names that ``given`` may stand for, itself included."""
    return _SHORT.get(given, frozenset()) | {given}


_CODE = str.maketrans("bfpvcgjkqsxzdtlmnr", "111122222222334556")


def phonetic(token: str) -> str:
    """First letter and the classes of the consonants after it, without repeats, vowels and h, w, y."""
    out, last = token[:1], ""
    for c in token[1:]:
        d = c.translate(_CODE)
        if d.isdigit():
            if d != last:
                out += d
            last = d
        elif c not in "hw":
            last = ""
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1; letters of short words may match one place apart, too."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 1)
    hit_b = [False] * len(b)
    ma = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_b[j] = True
                ma.append(c)
                break
    if not ma:
        return 0.0
    mb = [c for c, h in zip(b, hit_b, strict=True) if h]
    t = sum(x != y for x, y in zip(ma, mb, strict=True)) / 2
    m = len(ma)
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Least Jaro-Winkler similarity of two spellings of one surname, given name or word of a title, and of two titles
#: that divide their letters into words differently. Fitted by looking at the pairs around them; see the README.
SURNAME_JW, GIVEN_JW, WORD_JW, TITLE_JW = 0.85, 0.79, 0.86, 0.96
#: A word is established if it stands in that many titles, or a name with that many partners.
ESTABLISHED = 3
#: An established name can be a slip only of one with that many times its partners.
RARER = 4


def _rarer(na: int, nb: int) -> bool:
    """Whether the rarer of two names or words can be a slip of the other by their numbers."""
    return min(na, nb) < ESTABLISHED or min(na, nb) * RARER <= max(na, nb)


def _slip(a: str, b: str, na: int, nb: int, least: float) -> bool:
    """Whether one spelling is a slip of the other; na, nb: with how many partners each occurs."""
    return len(a) >= 3 and len(b) >= 3 and a != b and jaro_winkler(a, b) >= least and _rarer(na, nb)


# persons -----------------------------------------------------------------------------------------

_PARSED = "array<struct<surname:string,given:string,middle:string,sure:boolean>>"


def parse_person(name: str) -> list[tuple[str, str, str, bool]]:
    """Readings of a name as (surname tokens sorted, given name or initial, middle initials, sure).

    Nobody (empty, "et al.", groups) has none; a name of full words without a comma has one per order.
    """
    f = fold(name)
    if _ET_AL.match(f) or _GROUP.search(f):
        return []
    parts = [p for p in f.split(",")]
    raw = [p for p in name.split(",")]
    keep = [k for k, p in enumerate(parts) if (t := _TOKEN.findall(p)) and not all(x in _DEGREES for x in t)]
    if not keep:
        return []

    def given_of(tokens: list[str], written: str) -> tuple[str, str]:
        if not tokens:
            return "", ""
        first, rest = tokens[0], tokens[1:]
        w = written.strip()
        if len(tokens) == 1 and w.isupper() and not name.isupper() and (len(first) == 2 or len(first) == 3 and not any(c in "aeiouy" for c in first[1:])):
            return first[0], first[1:]  # initials written together
        return first, "".join(x[0] for x in rest)

    if len(keep) > 1:
        sur, giv = _TOKEN.findall(parts[keep[0]]), [x for x in _TOKEN.findall(parts[keep[1]]) if x not in _DEGREES or len(x) < 2]
        g, m = given_of(giv, raw[keep[1]] if len(raw) > keep[1] else "")
        return [(" ".join(sorted(sur)), g, m, True)]
    words = parts[keep[0]].split()
    written = raw[keep[0]].split() if len(raw) > keep[0] else words
    toks = [(_TOKEN.findall(w), x) for w, x in zip(words, written, strict=False)]
    toks = [(t, x) for t, x in toks if t]
    if len(toks) > 2:  # of two words the second is no degree but initials
        toks = [(t, x) for t, x in toks if not all(y in _DEGREES for y in t)]
    if len(toks) == 1:
        return [(" ".join(sorted(toks[0][0])), "", "", True)]

    def initials(k: int) -> bool:
        t, x = toks[k]
        return all(len(y) == 1 for y in t) or (len(t) == 1 and len(t[0]) <= 3 and x.isupper() and not name.isupper() and len(t[0]) < 4)

    def reading(sur: list, giv: list, sure: bool) -> tuple[str, str, str, bool]:
        s = sorted(y for t, _ in sur for y in t)
        flat = [y for t, _ in giv for y in t]
        g, m = given_of(flat, giv[0][1] if len(giv) == 1 else "x")
        return " ".join(s), g, m, sure

    if initials(len(toks) - 1):
        k = len(toks) - 1
        while k > 1 and initials(k - 1):
            k -= 1
        if k == 1 or not initials(0):
            # "Surname AB", or "Given Surname X": initials at the end follow a surname
            return [reading(toks[:k], toks[k:], True)]
    if initials(0):
        k = 1
        while k < len(toks) - 1 and initials(k):
            k += 1
        return [reading(toks[k:], toks[:k], True)]
    mid = [k for k in range(1, len(toks) - 1) if initials(k)]
    if mid:
        return [reading(toks[mid[-1] + 1 :], toks[: mid[-1] + 1], True)]
    out = [reading(toks[1:], toks[:1], False), reading(toks[:-1], toks[-1:], False)]
    return out


def _ends(w: str) -> set[str]:
    """Keys that two spellings of a word share if they are one slip apart: a half of them, or what is left without one letter."""
    keys = {"d" + w[:k] + w[k + 1 :] for k in range(len(w))} | {"d" + w} if len(w) < 7 else set()
    if len(w) > 5:
        for n in (len(w), len(w) + 1):  # the length of the longer one of two
            keys |= {f"a{n}{w[: n // 2]}", f"z{n}{w[n // 2 + 1 - n :]}"}
    return keys


#: Sides of a block: full names are compared with each other, initials with full names only.
BOTH, INITIAL, FULL = 0, 1, 2


def person_keys(surname: str, given: str) -> list[tuple[str, int]]:
    """Block keys of a reading, each with its side; none without a given name or initial."""
    if not given:
        return []
    squeezed = surname.replace(" ", "")
    near = {"c" + " ".join(phonetic(t) for t in surname.split()), "a" + squeezed[:4], "z" + squeezed[-4:]}
    if len(given) == 1:
        return [(f"i|{given}|{k}", INITIAL) for k in sorted(near)]
    full = full_names(given)
    keys = {(f"i|{x}|{k}", FULL) for x in {g[:1] for g in full} for k in near}
    if " " in surname:
        near |= {"t" + phonetic(t) for t in surname.split()}
    keys |= {(f"s|{given}|{k}", BOTH) for k in near}
    keys |= {(f"n|{surname}|{g}", BOTH) for g in full}
    keys |= {(f"g|{surname}|{k}", BOTH) for k in _ends(given) | {"p" + phonetic(given)}}
    return sorted(keys)


SAME, FIRST_INITIAL, SECOND_INITIAL, FIRST_SLIP, SECOND_SLIP = 1, 2, 3, 4, 5


def compare_persons(s1: str, g1: str, m1: str, ns1: int, ng1: int, s2: str, g2: str, m2: str, ns2: int, ng2: int) -> int:
    """0: different persons; else 10 x rank + kind, where a smaller rank is a better fit.

    Kinds: the same person; the first or second is an initial that fits the other; the first or second is
    a slip or a short form of the other. ns: given names with which the surname occurs, ng: surnames with which the
    given name occurs; the one with fewer is the slip.
    """
    if not g1 or not g2 or m1 and m2 and m1[0] != m2[0]:
        return 0
    a, b = s1.replace(" ", ""), s2.replace(" ", "")
    slip = a != b
    if slip and " " in s1 and " " in s2:
        # of double surnames only the words that differ are compared
        x, y = s1.split(), s2.split()
        a, b = "".join(t for t in x if t not in y), "".join(t for t in y if t not in x)
    if slip and not _slip(a, b, ns1, ns2, SURNAME_JW):
        return 0
    i1, i2 = len(g1) == 1, len(g2) == 1
    if i1 and i2:
        return SAME if g1 == g2 and m1 == m2 and m1 and not slip else 0
    if i1 or i2:
        f, i = (g2, g1) if i1 else (g1, g2)
        if not any(x[0] == i for x in full_names(f)):
            return 0
        return (FIRST_INITIAL if i1 else SECOND_INITIAL) + 10 * slip + 20 * (f[0] != i)
    if g1 == g2 and not slip:
        return SAME
    if slip and g1 == g2:
        first, rank = (ns1, s1) <= (ns2, s2), 1000 * (1 - jaro_winkler(a, b))
    elif not slip and full_names(g1) & full_names(g2):
        # a short form may stand for several names, so it has to fit one only
        first, rank = (g2 in full_names(g1), g1 < g2) > (g1 in full_names(g2), g2 < g1), 0
    elif not slip and _slip(g1, g2, ng1, ng2, GIVEN_JW):
        first, rank = (ng1, g1) <= (ng2, g2), 1000 * (1 - jaro_winkler(g1, g2))
    else:
        return 0
    return (FIRST_SLIP if first else SECOND_SLIP) + 10 * round(rank)


# journals ----------------------------------------------------------------------------------------

_SMALL_WORDS = frozenset("the of in and for on a an to de la le et der die das und y e".split())
_EDITION = re.compile(r"[(\[]\s*(?:online|print|electronic|internet|web)\s*[)\]]")
_TURNED = re.compile(r"^(.*),\s*([^,]*\b(?:of|in|for|on|de|der))\s*$")


def parse_journal(title: str) -> str:
    """A title's words in reading order, folded, without punctuation and edition; '' for nothing."""
    f = _EDITION.sub(" ", fold(title).replace("&", " and ")).strip(" .;:")
    m = _TURNED.match(f)
    if m:
        f = f"{m[2]} {m[1]}"
    return " ".join(_TOKEN.findall(f))


def journal_keys(norm: str) -> list[str]:
    """Block keys of a title: first letters and phonetic codes of its sorted words, and both ends of its letters.

    Each phonetic key leaves out one word, where a slip may be, but for its first or its last letter; the ends,
    which begin after the first word, find slips across two words.
    """
    content = [w for w in norm.split() if w not in _SMALL_WORDS]
    if not content:
        return [norm]
    words = sorted(content)
    head, rest = content[0], "".join(content[1:])
    keys = {"i" + "".join(w[0] for w in words), f"a{head[0]}{rest[:8]}", f"z{head[0]}{rest[-9:]}"}
    for k, out in enumerate(words):
        others = "p" + " ".join(phonetic(w)[:3] for j, w in enumerate(words) if j != k)
        keys |= {f"{others}|{out[0]}", f"{others}|~{out[-1]}"}
    return sorted(keys)


def _abbreviates(u: str, v: str) -> bool:
    """Whether ``u`` may be short for ``v``: its beginning, or a contraction with its first and last letters."""
    if len(u) >= len(v):
        return False
    if v.startswith(u):
        return True
    if len(u) > 5 or u[0] != v[0] or u[-1] != v[-1]:
        return False
    rest = iter(v)
    return all(c in rest for c in u)


def compare_journals(a: str, b: str, ca: list[int], cb: list[int], na: int, nb: int) -> int:
    """0: different; 1: same title; 2: the first, 3: the second one abbreviates the other.

    ca, cb: in how many titles each word occurs; na, nb: uses of the titles. A slip that turns one
    established word into another one makes two titles, unless the word or the title is much rarer.
    """
    count = dict(zip(a.split(), ca, strict=True)) | dict(zip(b.split(), cb, strict=True))
    x = [w for w in a.split() if w not in _SMALL_WORDS]
    y = [w for w in b.split() if w not in _SMALL_WORDS]
    if x == y or sorted(x) == sorted(y):
        return 1
    p, q = a.replace(" ", "").removeprefix("the"), b.replace(" ", "").removeprefix("the")
    if p == q:
        return 1
    differ = [(u, v) for u, v in zip(x, y, strict=False) if u != v]
    if len(x) != len(y):
        return int(min(len(p), len(q)) >= 12 and abs(len(p) - len(q)) <= 1 and jaro_winkler(p, q) >= TITLE_JW)
    if len(differ) == 1:
        u, v = differ[0]
        if min(len(u), len(v)) >= 5 and jaro_winkler(u, v) >= WORD_JW and not _abbreviates(u, v) and not _abbreviates(v, u):
            if _rarer(count[u], count[v]) or min(na, nb) * RARER <= max(na, nb):
                return 1
    if all(_abbreviates(u, v) for u, v in differ):
        return 2
    if all(_abbreviates(v, u) for u, v in differ):
        return 3
    return 0


# operators ---------------------------------------------------------------------------------------


def spellings(df: DataFrame, col: str) -> DataFrame:
    """(name, n): distinct non-empty strings of a string or array column, with their number of uses."""
    is_list = dict(df.dtypes)[col].startswith("array")
    e = df.select((F.explode(col) if is_list else F.col(col)).alias("name"))
    return e.where(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.count("*").alias("n"))


def _clusters(nodes: DataFrame, sure: DataFrame, fits: list[DataFrame], name: str) -> DataFrame:
    """(node, cluster): components of the sure links, then, fit after fit, what fits exactly one of them.

    Each of ``fits`` has (node, into, rank); of a node's fits only those of the least rank count.
    """
    _, labels = spanning_forest(sure, name)
    of = nodes.select(F.col("node").alias("v")).join(labels, "v", "left").select(F.col("v").alias("node"), F.coalesce("root", "v").alias("cluster"))
    for k, fit in enumerate(fits):
        of = materialize(of, f"{name}-clusters{k}")
        f = fit.join(of.select(F.col("node").alias("into"), "cluster"), "into").groupBy("node", "cluster").agg(F.min("rank").alias("rank"))
        best = F.min("rank").over(Window.partitionBy("node"))
        f = f.withColumn("best", best).where("rank = best").groupBy("node").agg(F.count("*").alias("k"), F.min("cluster").alias("only")).where("k = 1")
        # a component takes the cluster into which all its fitting nodes lead
        joined = of.join(f.select("node", "only"), "node").groupBy("cluster").agg(F.min("only").alias("lo"), F.max("only").alias("hi")).where("lo = hi")
        links = joined.where("cluster != lo").select(F.col("cluster").alias("a"), F.col("lo").alias("b"))
        _, more = spanning_forest(links, f"{name}-fits{k}")
        of = of.join(more.select(F.col("v").alias("cluster"), "root"), "cluster", "left").select("node", F.coalesce("root", "cluster").alias("cluster"))
    return of


def _pairs_in_blocks(blocked: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct pairs of nodes that share a block key, each with both nodes' columns suffixed 1 and 2.

    ``side`` tells what is compared: BOTH with each other, INITIAL (first) with FULL.
    """
    left = blocked.where(F.col("side") != FULL).select("key", F.col("side").alias("sl"), *[F.col(c).alias(c + "1") for c in cols])
    right = blocked.where(F.col("side") != INITIAL).select("key", F.col("side").alias("sr"), *[F.col(c).alias(c + "2") for c in cols])
    met = left.join(right, "key").where((F.col("sl") == INITIAL) & (F.col("sr") == FULL) | (F.col("sl") == BOTH) & (F.col("sr") == BOTH) & (F.col("node1") < F.col("node2")))
    return met.drop("key", "sl", "sr").distinct()


def link_persons(names: DataFrame) -> DataFrame:
    """(name, cluster) of every spelling in (name, n) that is a person's.

    Spellings that differ only in case, accents, spacing, punctuation, degrees or the order of their
    parts are one node; nodes are compared within blocks. Initials are joined to the one cluster of
    their surname that they fit, and stay alone if several fit. Null and empty names, "et al." and
    groups give no row.
    """

    @F.pandas_udf(_PARSED)
    def parse(s: pd.Series) -> pd.Series:
        keys = ("surname", "given", "middle", "sure")
        return s.map(lambda x: [dict(zip(keys, r, strict=True)) for r in parse_person(x)])

    names = names.where(F.col("name").isNotNull())
    r = materialize(names.select("name", "n", F.posexplode(parse("name")).alias("k", "r")).select("name", "n", "k", "r.*"), "readings")
    sure = r.where("sure")
    # in which order a name without a comma reads, is told by how the sure ones use its words
    as_surname = sure.where("surname != ''").groupBy("surname").agg(F.sum("n").alias("used_s"))
    as_given = sure.where("length(given) > 1").groupBy("given").agg(F.countDistinct("surname").alias("used_g"))
    scored = (
        r.where("not sure")
        .join(as_surname, "surname", "left")
        .join(as_given, "given", "left")
        .withColumn("score", F.ln(1 + F.coalesce("used_s", F.lit(0))) + F.ln(1 + F.coalesce("used_g", F.lit(0))))
    )
    pick = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "k"))
    chosen = scored.withColumn("i", pick).where("i = 1").select("name", "n", "surname", "given", "middle")
    read = sure.select("name", "n", "surname", "given", "middle").unionByName(chosen)
    read = materialize(read.withColumn("node", F.concat_ws("|", "surname", "given", "middle")), "persons")
    surname_n = read.groupBy("surname").agg(F.countDistinct(F.when(F.length("given") > 1, F.col("given"))).alias("ns"))
    given_n = read.groupBy("given").agg(F.countDistinct("surname").alias("ng"))
    nodes = read.select("node", "surname", "given", "middle").distinct().join(surname_n, "surname").join(given_n, "given")
    nodes = materialize(nodes, "person-nodes")

    @F.pandas_udf("array<struct<key:string,side:int>>")
    def keys(s: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "side": x} for k, x in person_keys(a, b)] for a, b in zip(s, g, strict=True)])

    @F.pandas_udf("int")
    def compare(s1: pd.Series, g1: pd.Series, m1: pd.Series, a1: pd.Series, b1: pd.Series, s2: pd.Series, g2: pd.Series, m2: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.Series:
        return pd.Series([compare_persons(*x) for x in zip(s1, g1, m1, a1, b1, s2, g2, m2, a2, b2, strict=True)], dtype="int32")

    cols = ["node", "surname", "given", "middle", "ns", "ng"]
    pairs = _pairs_in_blocks(nodes.withColumn("k", F.explode(keys("surname", "given"))).select(*cols, "k.key", "k.side"), cols)
    args = [c + i for i in "12" for c in ("surname", "given", "middle", "ns", "ng")]
    judged = materialize(pairs.select("node1", "node2", compare(*args).alias("same")).where("same > 0"), "person-links")
    full = judged.where("same = 1")
    # where one surname and given name go with several middle initials, a name without one is nobody's for sure
    middles = nodes.where("middle != ''").groupBy("surname", "given").agg(F.countDistinct(F.substring("middle", 1, 1)).alias("k")).where("k > 1")
    unsure = nodes.where("middle = ''").join(middles, ["surname", "given"]).select("node")
    full = full.join(unsure.withColumnRenamed("node", "node1"), "node1", "left_anti").join(unsure.withColumnRenamed("node", "node2"), "node2", "left_anti")
    kind, rank = F.col("same") % 10, F.floor(F.col("same") / 10)

    def fit(first: int, second: int) -> DataFrame:
        return judged.where(kind.isin(first, second)).select(
            F.when(kind == first, F.col("node1")).otherwise(F.col("node2")).alias("node"),
            F.when(kind == first, F.col("node2")).otherwise(F.col("node1")).alias("into"),
            rank.alias("rank"),
        )

    fits = [fit(FIRST_SLIP, SECOND_SLIP), fit(FIRST_INITIAL, SECOND_INITIAL)]
    c = _clusters(nodes, full.select(F.col("node1").alias("a"), F.col("node2").alias("b")), fits, "persons")
    return read.select("name", "node").join(c, "node").select("name", "cluster")


def link_journals(names: DataFrame) -> DataFrame:
    """(name, cluster) of every journal spelling in (name, n).

    Case, accents, punctuation, small words and a turned order ("X, Archives of") make no difference; a
    slip is accepted by Jaro-Winkler similarity towards a much more frequent word or title; an abbreviation joins the one
    title that it can stand for. Null and empty titles give no row.
    """

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(parse_journal)

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(journal_keys)

    @F.pandas_udf("int")
    def compare(a: pd.Series, b: pd.Series, ca: pd.Series, cb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([compare_journals(*x) for x in zip(a, b, ca, cb, na, nb, strict=True)], dtype="int32")

    names = names.where(F.col("name").isNotNull())
    read = materialize(names.select("name", "n", parse("name").alias("node")).where("node != ''"), "journals")
    titles = read.select("node").distinct()
    words = titles.select("node", F.posexplode(F.split("node", " ")).alias("at", "w"))
    counts = words.groupBy("w").agg(F.countDistinct("node").cast("int").alias("c"))
    c = words.join(counts, "w").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("c"))
    nodes = materialize(c.join(read.groupBy("node").agg(F.sum("n").alias("n")), "node"), "journal-nodes")
    pairs = _pairs_in_blocks(nodes.withColumn("key", F.explode(keys("node"))).withColumn("side", F.lit(BOTH)), ["node", "c", "n"])
    judged = materialize(pairs.select("node1", "node2", compare("node1", "node2", "c1", "c2", "n1", "n2").alias("same")).where("same > 0"), "journal-links")
    fits = judged.where("same > 1").select(
        F.when(F.col("same") == 2, F.col("node1")).otherwise(F.col("node2")).alias("node"),
        F.when(F.col("same") == 2, F.col("node2")).otherwise(F.col("node1")).alias("into"),
        F.lit(0).alias("rank"),
    )
    # an abbreviation stands for titles that are no abbreviations themselves
    whole = fits.join(fits.select(F.col("node").alias("into")).distinct(), "into", "left_anti").select("node", "into", "rank")
    c = _clusters(nodes, judged.where("same = 1").select(F.col("node1").alias("a"), F.col("node2").alias("b")), [whole], "journals")
    return read.select("name", "node").join(c, "node").select("name", "cluster")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """(name_a < name_b): all pairs of spellings in one cluster."""
    a = clusters.select("cluster", F.col("name").alias("name_a"))
    b = clusters.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b").distinct()
