"""Problem 5: personal details inside free text, replaced by typed placeholders.

Method: a linear-chain conditional random field over word-shape features, trained from the small
labelled table of ``pii_labels`` and decoded by Viterbi in numpy batches.

A token's score for a label is a sum over the tokens around it, and what a token adds at a distance
depends on its features alone. Scores are therefore looked up by token, and a batch of texts is
scored by a few array additions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm import pii_labels
from corpuslane.llm.pii_labels import KINDS

_TOKEN = re.compile(r"[^\W_]+(?:[._+\-'’][^\W_]+)*|[^\w\s]|_")
_MARK = re.compile(r"\{(\w+)\|([^}]*)\}")

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
#: Distances at which a token adds to a score.
REACH = range(-4, 5)
#: Tokens whose scores a task keeps at hand.
CACHE = 100_000
#: Texts and tokens that are decoded at a time.
TEXTS, GROUP = 5000, 400_000

#: Word classes, fixed values of general use: they let a cue that was seen with one word count for the others of its class.
_CLASSES = {
    "street": "street st road rd lane ln avenue ave close crescent drive dr boulevard blvd way court ct place pl square terrace parkway highway hill row circle rue allee weg platz gasse calle via straat apt apartment suite unit box",
    "kin": "wife husband son daughter mother father brother sister partner spouse friend neighbour neighbor aunt uncle cousin nephew niece grandson granddaughter grandmother grandfather fiance mom dad parent guardian caregiver proxy stepson roommate",
    "title": "dr drs mr mrs ms miss prof nurse sr doctor professor sgt rn chaplain",
    "role": "md do np pa rn phd pharmd lpn pt ot msw licsw attending physician surgeon resident provider author pcp consultant therapist pharmacist dietitian interpreter witness nurse fellow intern clerk",
    "phone-word": "tel telephone phone ph cell cellphone mobile fax pager beeper call callback ring dial text voicemail landline hotline extension reach reached reachable phoned",
    "id-word": "ssn ss social security mrn mr medical record chart passport member insurance policy subscriber medicare medicaid id",
    "other-number": "order lot specimen sample accession batch serial device model ticket invoice requisition request protocol trial tube barcode tracking kit slide case reference confirmation job prescription rx cassette catalogue form room bed bay ward unit",
    "telling": "spoke spoken talked discussed called told informed updated notified paged signed dictated transcribed reviewed cosigned seen evaluated examined referred authenticated verified witnessed assisted accompanied visited entered prepared approved",
    "living": "lives living resides residing address discharged moved staying stays mail letter letters deliver delivered home house",
    "mail-word": "email mail mailto e-mail emailed write writes portal",
    "eponym-head": "disease syndrome sign score scale test phenomenon lymphoma catheter monitor mask coma dementia palsy reflex tube drain fracture maneuver procedure position virus contracture criteria classification thyroiditis needle line bodies cells stain ulcer",
    "month": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday",
    "small": "the a an of in on at to for with by from and or as is was are were be has had who that this if no not his her he she it they about after before re per via than then when w",
    "dotted": "dot at",
    "unit": "mg ml mcg g kg l iu units mmol meq dl u ng mmhg bpm cm mm min h hr tabs puffs drops µg",
    "grade": "mild moderate severe marked slight minimal diffuse focal early late partial complete subtle extensive acute chronic new old small large recent likely possible probable unlikely no resolving worsening unchanged",
}
_CLASS_OF: dict[str, list[str]] = {}
for _c, _ws in _CLASSES.items():
    for _w in _ws.split():
        _CLASS_OF.setdefault(_w, []).append("c:" + _c)


def _shape(w: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m.group().isupper() and len(m.group()) > 1 else "Xx" if m.group()[0].isupper() else "x", w)
    return re.sub(r"\d+", lambda m: f"d{min(len(m.group()), 9)}", s)


def features(w: str) -> list[str]:
    """Features of a token: its shape, affixes and word classes, and the word itself."""
    low = w.lower()
    bare = re.sub(r"\d", "0", low)
    out = ["bias", "s:" + _shape(w), "ls:" + _shape(low), "w:" + bare]
    out += _CLASS_OF.get(low, ())
    if low.isalpha():
        n = len(low)
        out += ["p:" + low[:2], "f:" + low[-2:], "g:" + low[-3:], "len:" + str(min(n, 12)), "alpha"]
        if low.endswith(("weg", "strasse", "straße", "gasse", "allee", "platz", "straat", "vej", "gatan")) and n > 5:
            out.append("joined-street")
        if w[0].isupper() and low not in _CLASS_OF:
            out.append("capital")
    elif low.isdigit():
        out.append("digits")
    elif len(low) > 1:
        out.append("mixed")
        if any(c.isdigit() for c in low):
            out.append("has-digit")
            out.append("n-digits:" + str(min(sum(c.isdigit() for c in low), 11)))
        out += ["has" + c for c in "._+-" if c in low]
    return out


@dataclass
class Crf:
    """Weights: per distance a table (features x labels), and label transitions."""

    index: dict[str, int]
    weights: np.ndarray  # distances x features x labels
    trans: np.ndarray  # labels x labels
    first: np.ndarray

    def rows(self, w: str) -> np.ndarray:
        """What a token adds, per distance and label."""
        f = [self.index[x] for x in features(w) if x in self.index]
        return self.weights[:, f].sum(axis=1)


def _allowed() -> np.ndarray:
    """0 where a label may follow another one, else a large negative number."""
    a = np.zeros((N, N))
    for j, y in enumerate(LABELS):
        if y[0] == "I":
            for i, x in enumerate(LABELS):
                if x[1:] != y[1:]:
                    a[i, j] = -1e4
    return a


def labelled(rows: list[str] | None = None) -> list[tuple[list[str], list[int]]]:
    """The labelled table as tokens and label numbers; some rows also in upper and in lower case."""
    out = []
    rng = np.random.default_rng(3)
    for r in pii_labels.rows() if rows is None else rows:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(r):
            text += r[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += r[at:]
        draw = rng.random()
        for t in (text, text.lower()) if draw < 0.5 else (text, text.upper()) if draw < 0.7 else (text,):
            if len(t) != len(text):
                continue
            toks, labs = [], []
            for m in _TOKEN.finditer(t):
                toks.append(m.group())
                lab = 0
                for a, b, k in spans:
                    if a <= m.start() < b:
                        lab = LABELS.index(("B-" if m.start() == a else "I-") + k)
                labs.append(lab)
            out.append((toks, labs))
    # rows follow each other in notes, so the model sees neighbours on both sides
    mixed = [out[k] for k in rng.permutation(len(out))]
    return [(sum((x[0] for x in mixed[k : k + 3]), []), sum((x[1] for x in mixed[k : k + 3]), [])) for k in range(0, len(mixed), 3)]


def minimise(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search; ``f`` gives value and gradient."""
    v, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(rounds):
        d = -g
        alphas = []
        for s, y, rho in reversed(steps):
            alphas.append(rho * float(s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            d = d * (1 / (rho * float(y @ y)))
        for (s, y, rho), al in zip(steps, reversed(alphas), strict=True):
            d = d + (al - rho * float(y @ d)) * s
        t = 1.0 if k else 1.0 / max(1e-9, float(np.abs(g).sum()) / 50)
        slope = float(g @ d)
        for _ in range(12):
            x2 = x + t * d
            v2, g2 = f(x2)
            if v2 <= v + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = x2 - x, g2 - g
        if float(s @ y) > 1e-10:
            steps = [*steps, (s, y, 1 / float(s @ y))][-memory:]
        if abs(v - v2) < 1e-5 * abs(v):
            return x2
        x, v, g = x2, v2, g2
    return x


@functools.lru_cache(maxsize=1)
def train(rounds: int = 60, l2: float = 0.2) -> Crf:
    """The field fitted to the labelled table."""
    return fit(labelled(), rounds, l2)


def fit(data: list[tuple[list[str], list[int]]], rounds: int = 60, l2: float = 0.3) -> Crf:
    """Fit a field to labelled token sequences: the penalised log-likelihood's maximum, by L-BFGS; deterministic."""
    types: dict[str, int] = {}
    ids = [[types.setdefault(w, len(types)) for w in t] for t, _ in data]
    index: dict[str, int] = {}
    feats = [[index.setdefault(x, len(index)) for x in features(w)] for w in types]
    # features of all types in one list; the last type stands for what is outside a text and has none
    feat = np.array([x for f in feats for x in f])
    type_ = np.repeat(np.arange(len(types)), [len(f) for f in feats])
    slots = np.full((max(map(len, feats)), len(types)), len(index))  # the k-th feature of each type
    for k, f in enumerate(feats):
        slots[: len(f), k] = f
    order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
    d, nf, nt = len(REACH), len(index), len(types)
    nw = d * nf * N
    allowed = _allowed().astype(np.float32)
    f0 = np.zeros(N, np.float32)
    f0[[k for k, v in enumerate(LABELS) if v[0] == "I"]] = -1e4
    pairs = np.zeros((N, N))
    parts = []  # of sequences of like length, so that little is padded
    for rows in np.array_split(np.array(order), max(1, min(8, len(order) // 50))):
        size = np.array([len(ids[k]) for k in rows])
        b, n = len(rows), int(size[0])
        x = np.full((b, n + d - 1), nt)
        y = np.zeros((b, n), np.int64)
        for row, k in enumerate(rows):
            x[row, REACH[-1] : REACH[-1] + len(ids[k])] = ids[k]
            y[row, : len(ids[k])] = data[k][1]
        live = [int((size > i).sum()) for i in range(n)]
        mask = np.arange(n) < size[:, None]
        gold = np.eye(N, dtype=np.float32)[y] * mask[..., None]
        for i in range(1, n):
            np.add.at(pairs, (y[: live[i], i - 1], y[: live[i], i]), 1)
        parts.append((b, n, x, live, mask, gold))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[:nw].reshape(d, nf, N).astype(np.float32), p[nw:].reshape(N, N).astype(np.float32)
        rows = np.zeros((nf + 1, d * N), np.float32)  # the last feature stands for none
        rows[:-1] = w.transpose(1, 0, 2).reshape(nf, d * N)
        of_type = rows.take(slots[0], axis=0)
        for slot in slots[1:]:
            of_type += rows.take(slot, axis=0)
        table = np.zeros((d, nt + 1, N), np.float32)  # distances x types x labels
        table[:, :-1] = of_type.reshape(nt, d, N).transpose(1, 0, 2)
        ex = np.exp(t + allowed)
        value, gt, by_type = 0.0, np.zeros((N, N)), np.zeros((d, N, nt + 1))
        for b, n, x, live, mask, gold in parts:
            e = np.zeros((b, n, N), np.float32)
            for k in range(d):
                e += table[k].take(x[:, k : k + n], axis=0)
            # scaled forward and backward passes
            top = e.max(2)
            ee = np.exp(e - top[..., None])
            al, be = np.zeros_like(e), np.ones_like(e)
            scale = np.ones((b, n), np.float32)
            al[:, 0] = ee[:, 0] * np.exp(f0)
            for i in range(n):
                c = live[i]
                if i:
                    al[:c, i] = (al[:c, i - 1] @ ex) * ee[:c, i]
                scale[:c, i] = al[:c, i].sum(1)
                al[:c, i] /= scale[:c, i, None]
            for i in range(n - 1, 0, -1):
                c = live[i]
                q = ee[:c, i] * be[:c, i] / scale[:c, i, None]
                be[:c, i - 1] = q @ ex.T
                gt += (al[:c, i - 1].T @ q) * ex
            value += float((np.log(scale) * mask).sum() + (top * mask).sum() - (e * gold).sum())
            ge = np.ascontiguousarray((al * be - gold)[mask].T)
            for k in range(d):
                col = x[:, k : k + n][mask]
                for c in range(N):
                    by_type[k, c] += np.bincount(col, weights=ge[c], minlength=nt + 1)
        gw = np.empty((d, nf, N))
        for k in range(d):
            for c in range(N):
                gw[k, :, c] = np.bincount(feat, weights=by_type[k, c][type_], minlength=nf)
        grad = np.concatenate((gw.ravel(), (gt - pairs).ravel())) + l2 * p
        return value - float((pairs * t).sum()) + l2 / 2 * float(p @ p), grad

    p = minimise(loss, np.zeros(nw + N * N), rounds)
    return Crf(index, p[:nw].reshape(d, nf, N).astype(np.float32), p[nw:].reshape(N, N).astype(np.float32) + allowed, f0)


class _Types(dict):
    """Numbers of tokens; a new token gets its scores computed."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self[""] = 0  # what is outside a text adds nothing
        self.table = np.zeros((len(REACH), 1024, N), np.float32)

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self)
        if k == self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), 1)
        self.table[:, k] = self.crf.rows(w)
        return k


class Tagger:
    """Decodes batches of texts with a trained field."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.types = _Types(crf)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text its details as (start, end, kind)."""
        if len(self.types) > CACHE:
            self.types = _Types(self.crf)
        get, flat, sizes = self.types.__getitem__, [], []
        gap = [0] * REACH[-1]
        for t in texts:
            before = len(flat)
            flat += map(get, _TOKEN.findall(t))
            sizes.append(len(flat) - before)
            flat += gap
        x = np.array(gap + flat + gap, dtype=np.int64)
        length = np.array(sizes, np.int64)
        first = np.concatenate(([0], np.cumsum(length + len(gap))))[:-1]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        label = np.zeros(len(flat), np.int8)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        lo = 0
        while lo < len(order):
            # groups of like length, so that little is padded and memory stays bounded
            top = int(length[order[lo]])
            hi = lo + int(np.searchsorted(-length[order[lo:]], -(top * 7 // 10), side="right"))
            hi = min(max(hi, lo + 1), lo + max(1, GROUP // top))
            g = order[lo:hi]
            self._viterbi(x, first[g], first[g] + length[g], label)
            lo = hi
        hit = np.flatnonzero(label)
        owner = np.searchsorted(first, hit, side="right") - 1
        for k in np.unique(owner):
            spans = [m.span() for m in _TOKEN.finditer(texts[k])]
            out[k] = self._spans(texts[k], label, hit[owner == k], int(first[k]), spans)
        return out

    def _viterbi(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
        """Label the stretches [a, b), longest first."""
        size = b - a
        n, m = int(size[0]), len(a)
        at = a + np.arange(n)[:, None]
        at = np.minimum(at, b - 1)
        e = np.zeros((n, m, N), np.float32)
        for k in range(len(REACH)):
            e += self.types.table[k].take(x.take(at + k), axis=0)
        alive = [int(np.searchsorted(-size, -i, side="left")) for i in range(n)]  # stretches longer than i
        tr = np.ascontiguousarray(self.crf.trans.T)  # to x from
        score = e[0] + self.crf.first
        back = np.zeros((n, m, N), np.int8)
        every = np.arange(m * N)
        for i in range(1, n):
            c = alive[i]
            s = (score[:c, None, :] + tr).reshape(-1, N)
            k = s.argmax(1)
            back[i, :c] = k.reshape(c, N)
            score[:c] = s[every[: c * N], k].reshape(c, N) + e[i, :c]
        cur = score.argmax(1)
        rows = np.arange(m)
        for i in range(n - 1, -1, -1):
            c = alive[i]
            label[at[i, :c]] = cur[:c]
            if i:
                cur[:c] = back[i, :c][rows[:c], cur[:c]]

    @staticmethod
    def _spans(text: str, label: np.ndarray, hit: np.ndarray, first: int, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        out, k = [], 0
        while k < len(hit):
            i = j = int(hit[k])
            kind = LABELS[label[i]][2:]
            while k + 1 < len(hit) and hit[k + 1] == j + 1 and LABELS[label[j + 1]] == "I-" + kind:
                j += 1
                k += 1
            k += 1
            fixed = tidy(text, spans[i - first][0], spans[j - first][1], kind)
            if fixed:
                out.append((*fixed, kind))
        return out


_AT = re.compile(r"@|[(\[]\s*at\s*[)\]]|\bat\b", re.I)
_PHONE = re.compile(r"\+\s?\d|\(\d+\)|\d")
_PLACEHOLDER = re.compile(r"\[\*\*[^\]]*\*\*\]|\[[A-Z_]+\]|<[A-Z_]+>")


def tidy(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact check: a detail's limits without labels and punctuation, or None if it cannot be one."""
    s = text[a:b]
    if kind == "phone":
        m = _PHONE.search(s)
        if not m or not 7 <= sum(c.isdigit() for c in s) <= 15:
            return None
        a += m.start()
    elif kind == "id_number":
        m = re.search(r"[^\W_]", s)
        if not m or sum(c.isdigit() for c in s) < 6:
            return None
        a += m.start()
    elif kind == "email":
        if not _AT.search(s):
            return None
        m = re.match(r"(?:mailto:|[<(\[\s:;,])+", s, re.I)
        a += m.end() if m else 0
    else:
        m = re.search(r"[^\W_]", s)
        if not m or kind == "name" and any(c.isdigit() for c in s):
            return None
        a += m.start()
    while b > a and text[b - 1] in " \t\r\n,;:-":
        b -= 1
    line = text[max(0, a - 60) : b + 60]
    for m in _PLACEHOLDER.finditer(line):
        if m.start() + max(0, a - 60) < b and a < m.end() + max(0, a - 60):
            return None
    return (a, b) if b > a else None


_TAGGERS: list[Tagger] = []


def _kept(crf: Crf) -> Tagger:
    """The worker's tagger for ``crf``, so that the next task finds the scores of tokens that it has seen."""
    if not _TAGGERS or _TAGGERS[0].crf is not crf:
        _TAGGERS[:] = [Tagger(crf)]
    return _TAGGERS[0]


_DETAILS = "array<struct<kind:string,start_char:int,end_char:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))


def with_details(df: DataFrame, text: str, out: str = "details") -> DataFrame:
    """``df`` with a column of the details found in ``text``: kind and half-open character offsets.

    Null and empty texts get an empty list. Whole texts are decoded, whatever their length. The field
    is trained on the driver (its table is a part of this package) and sent to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(train())

    @F.arrow_udf(_DETAILS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = _kept(shared.value)
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), TEXTS):
                part = [t or "" for t in batch.slice(lo, TEXTS).to_pylist()]
                rows += [[{"kind": k, "start_char": a, "end_char": b} for a, b, k in x] for x in tagger.find(part)]
            yield pa.array(rows, _TYPE)

    # called nondeterministic, the function is not copied into filters, so a text is decoded once
    return df.withColumn(out, find.asNondeterministic()(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: ``text`` whose details are replaced by ``[KIND]``, all else unchanged; null stays null."""
    d = with_details(df, text, "_details")
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("string").alias("s"))
    cut = F.aggregate(
        "_details",
        start,
        lambda acc, x: F.struct(
            x["end_char"].alias("at"),
            F.concat(acc["s"], F.substring(t, acc["at"] + 1, x["start_char"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("s"),
        ),
        lambda acc: F.concat(acc["s"], F.substring(t, acc["at"] + 1, F.length(t))),
    )
    return d.withColumn(out, F.when(t.isNotNull(), cut)).drop("_details")
