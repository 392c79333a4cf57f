"""Personal data by weak supervision.

Patterns propose spans: the base kinds, spelt-out addresses, national numbers, names after a
title, keys and tokens.  Six labelers vote on each (yes, no or abstain): form, structure,
gazetteer, context words, borders, and counter-context.  Votes are counted per pattern over all
documents; expectation-maximisation on those counts estimates how reliable each labeler is for
each kind and how likely each pattern is personal data.  A logistic regression is then fitted to the
estimates and decides the spans that go beyond the base kinds.

Base spans (e-mail, IP address, card, phone number, by fixed rules) are always returned.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_and_bytes, slices
from riskweave.session import stage

KINDS = ("email", "ip", "card", "phone", "name", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("form", "structure", "gazetteer", "context", "borders", "counter_context")
CONTEXT_CHARS = 48
EM_ROUNDS = 100
# A span beyond the base kinds is added from this probability on.
ADD_AT = 0.9

# ---- fixed values: gazetteers and context words ----------------------------------------------
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co eu de fr es it nl be ch at uk us ca au jp cn in "
    "br mx ru pl se no fi dk pt ie nz za kr".split()
)
# Two-digit country calling codes and the one-digit ones; others have three digits.
SHORT_CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 "
    "63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara "
    "Richard Susan Joseph Jessica Thomas Sarah Charles Karen Hans Anna Peter Ursula Wolfgang "
    "Monika Klaus Petra Jean Marie Pierre Isabelle Michel Nathalie Philippe Sophie José María "
    "Antonio Carmen Manuel Juan Francisco".split()
)
CONTEXT_WORDS = {
    "email": "mail e-mail email contact write courriel correo",
    "ip": "ip host server address login addr adresse client",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel call mobile fax telefon téléphone teléfono whatsapp",
    "name": "name signed dear regards sincerely contact",
    "secret": "token key apikey api_key secret password passwd pwd auth bearer credential",
}
COUNTER_WORDS = {
    "email": "example@ noreply no-reply",
    "ip": "version release build section v. ver",
    "card": "isbn order invoice serial hash token sku id",
    "phone": "order invoice serial isbn",
    "name": "",
    "secret": "sha sha1 sha256 md5 commit checksum digest revision uuid etag",
}
# How keys of well-known services begin.
KEY_BEGINNINGS = ("sk-", "sk_", "pk_", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-",
                  "AKIA", "ASIA", "AIza", "eyJ", "npm_", "pypi-", "hf_")

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELT = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,63})+")
_NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? [A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?")
# Runs of the characters that keys are written in, with letters and digits both.
_SECRET = re.compile(
    r"(?<![\w+/=.@-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[\w+/-]{20,256}+={0,2}"
    r"(?![\w+/@-])", re.ASCII)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


# ---- base spans -----------------------------------------------------------------------------

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and a domain of two labels or more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in found.split("."))


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def base_form(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern also meets its rule."""
    if kind == "ip":
        return octets(found)
    if kind == "card":
        return len(found) <= 37 and 14 <= len(d := _digits(found)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= sum("0" <= c <= "9" for c in found) <= 15
    return True


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    refuted: bool = False


def candidates(text: str) -> list[Span]:
    """All spans that the patterns propose, by start, then kind; base ones are marked."""
    out = [Span("email", a, b, True) for a, b in emails(text)]
    out += [Span("email", *m.span(), False) for m in _SPELT.finditer(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            good = base_form(kind, m.group())
            if good or kind != "card" or 14 <= m.end() - m.start() <= 37:
                out.append(Span(kind, *m.span(), good, not good))
    out += [Span("phone", *m.span(), False) for m in _NATIONAL.finditer(text)]
    out += [Span("name", *m.span(), False) for m in _NAME.finditer(text)]
    out += [Span("secret", *m.span(), False) for m in _SECRET.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# ---- labelers -------------------------------------------------------------------------------

def _mentions(words: str, around: str) -> bool:
    return any(re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", around)
               for w in words.split())


def entropy(found: str) -> float:
    """Bits per character."""
    counts = [found.count(c) for c in set(found)]
    return -sum(n / len(found) * math.log2(n / len(found)) for n in counts)


def votes(text: str, span: Span) -> str:
    """One of ``+``, ``-`` and ``0`` (abstains) for each labeler."""
    found, kind = text[span.start:span.end], span.kind
    around = text[max(0, span.start - CONTEXT_CHARS):span.end + CONTEXT_CHARS // 2].lower()
    digits = _digits(found[:64])
    form = "+" if span.base else "-" if span.refuted else "0"
    structure = gazetteer = "0"
    if kind == "email":
        last = re.split(r"[.\s)\]]", found.rstrip(")]"))[-1].lower()
        structure = "-" if ".." in found or found[0] in ".-" else "+"
        gazetteer = "+" if last in TOP_DOMAINS else "-"
    elif kind == "ip":
        parts = found.split(".")
        structure = "+" if octets(found) and all(p == "0" or p[0] != "0" for p in parts) else "-"
        gazetteer = "-" if parts[0] in ("0", "127", "255") or len(parts[0]) > 3 else "0"
    elif kind == "card":
        structure = "+" if luhn(digits) else "-"
        gazetteer = "+" if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|62", digits) else "-"
    elif kind == "phone":
        structure = "+" if 10 <= len(digits) <= 15 else "-"
        if found[0] == "+":
            known = (digits[:1] in SHORT_CALLING_CODES or digits[:2] in SHORT_CALLING_CODES
                     or digits[:1] in "23456789" and len(digits) > 3)
            gazetteer = "+" if known else "-"
    elif kind == "secret":
        # random digits differ more than words and numbers do
        structure = "+" if entropy(found) >= 3.2 and 12 * len(digits) >= len(found[:64]) else "-"
        gazetteer = "+" if found.startswith(KEY_BEGINNINGS) else "0"
    else:
        given = found.split()[1:]
        structure = "+" if len(given) > 1 else "0"
        gazetteer = "+" if given[0] in FIRST_NAMES else "0"
    context = "+" if _mentions(CONTEXT_WORDS[kind], around) else "0"
    before = text[span.start - 1] if span.start else " "
    after = text[span.end] if span.end < len(text) else " "
    borders = "-" if before.isalnum() or after.isalnum() else "+"
    counter = "-" if _mentions(COUNTER_WORDS[kind], around) else "0"
    return form + structure + gazetteer + context + borders + counter


def shape(text: str, span: Span) -> str:
    """Coarse form of a span: length, share of digits, the characters beside it."""
    found = text[span.start:span.end]
    side = lambda c: "w" if c.isalnum() else "s" if c.isspace() else "p"
    before = side(text[span.start - 1]) if span.start else "s"
    after = side(text[span.end]) if span.end < len(text) else "s"
    digits = sum(c.isdigit() for c in found[:64]) / min(len(found), 64)
    return f"{min(6, int(math.log2(len(found) + 1)))}{int(4 * digits)}{before}{after}"


def features(kind: str, marks: str, form: str) -> list[float]:
    """Features of the span classifier, from the three keys that spans are counted by."""
    value = {"+": 1.0, "-": -1.0, "0": 0.0}
    return [*(float(kind == k) for k in KINDS), *(value[m] for m in marks), float(form[0]) / 6,
            float(form[1]) / 4, *(float(form[i] == c) for i in (2, 3) for c in "wp")]


# ---- estimation -----------------------------------------------------------------------------

@dataclass
class Reliability:
    """What expectation-maximisation has found."""

    prior: dict[str, float] = field(default_factory=dict)
    # per labeler: probability of each vote, given personal data or not; over all kinds, and by
    # kind, which is what decides
    given: list[dict[str, tuple[float, float]]] = field(default_factory=list)
    by_kind: dict[str, list[dict[str, tuple[float, float]]]] = field(default_factory=dict)

    def posterior(self, kind: str, marks: str) -> float:
        p = self.prior.get(kind, 0.5)
        yes, no = math.log(p), math.log(1 - p)
        for labeler, mark in zip(self.by_kind.get(kind, ()), marks):
            a, b = labeler[mark]
            yes, no = yes + math.log(a), no + math.log(b)
        return 1 / (1 + math.exp(min(700.0, no - yes)))


def estimate(counts: dict[tuple[str, str], int], rounds: int = EM_ROUNDS) -> Reliability:
    """Reliability of the labelers from ``(kind, votes) -> number of spans``, beginning at the
    majority of the votes.  Votes are taken as independent given the truth."""
    belief = {k: min(0.95, max(0.05, 0.5 + 0.15 * (k[1].count("+") - k[1].count("-"))))
              for k in counts}
    found = Reliability()

    def reliabilities(mine: list[tuple[str, int, float]]) -> list[dict]:
        given = []
        for j in range(len(LABELERS)):
            yes, no = dict.fromkeys("+-0", 1.0), dict.fromkeys("+-0", 1.0)
            for marks, n, b in mine:
                yes[marks[j]] += n * b
                no[marks[j]] += n * (1 - b)
            given.append({m: (yes[m] / sum(yes.values()), no[m] / sum(no.values()))
                          for m in "+-0"})
        return given

    for _ in range(rounds if counts else 0):
        of = {kind: [(marks, n, belief[k, marks]) for (k, marks), n in counts.items()
                     if k == kind] for kind in sorted({k for k, _ in counts})}
        prior = {kind: (sum(n * b for _, n, b in mine) + 1) / (sum(n for _, n, _ in mine) + 2)
                 for kind, mine in of.items()}
        found = Reliability(prior, reliabilities([v for mine in of.values() for v in mine]),
                            {kind: reliabilities(mine) for kind, mine in of.items()})
        now = {key: found.posterior(*key) for key in counts}
        moved = max(abs(now[k] - belief[k]) for k in counts)
        belief = now
        if moved < 1e-6:
            break
    return found


@dataclass
class SpanClassifier:
    """Logistic regression over ``features``; ``None`` adds nothing."""

    weights: list[float] | None = None
    intercept: float = 0.0

    def probability(self, kind: str, marks: str, form: str) -> float:
        if self.weights is None:
            return 0.0
        z = self.intercept + float(np.dot(self.weights, features(kind, marks, form)))
        return 1 / (1 + math.exp(min(700.0, max(-700.0, -z))))


def fit_classifier(keyed: DataFrame, found: Reliability) -> SpanClassifier:
    """Fit to the estimated labels of ``kind, votes, shape, n`` (one row per combination)."""
    rows = []
    for r in keyed.toLocalIterator():
        p = found.posterior(r["kind"], r["votes"])
        x = features(r["kind"], r["votes"], r["shape"])
        rows += [(x, 1.0, r["n"] * p), (x, 0.0, r["n"] * (1 - p))]
    mass = [sum(w for _, y, w in rows if y == label) for label in (0.0, 1.0)]
    if min(mass) <= 1e-6:
        return SpanClassifier()
    data = keyed.sparkSession.createDataFrame(rows, "x array<double>, label double, weight double")
    data = data.select(array_to_vector("x").alias("features"), "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=100).fit(
        data.where("weight > 0"))
    return SpanClassifier(model.coefficients.toArray().tolist(), float(model.intercept))


# ---- jobs -----------------------------------------------------------------------------------

CANDIDATES = ("doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,"
              "refuted:boolean,votes:string,shape:string>>")


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: all candidates of every whole text with their votes, stored."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("base", pa.bool_()), ("refuted", pa.bool_()), ("votes", pa.string()),
                      ("shape", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            spans = []
            for body in batch.column("body").to_pylist():
                text = body.decode()
                spans.append([{**vars(s), "votes": votes(text, s), "shape": shape(text, s)}
                              for s in candidates(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(item))],
                names=["doc_id", "spans"])

    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(rows.mapInArrow(run, CANDIDATES), "candidates")


def learn(proposed: DataFrame) -> tuple[Reliability, SpanClassifier]:
    """Counts per combination over all documents; at most a few thousand reach the driver."""
    keyed = stage(
        proposed.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shape")
        .groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")), "votes")
    counts = {(r["kind"], r["votes"]): r["n"] for r in
              keyed.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    found = estimate(counts)
    return found, fit_classifier(keyed, found)


def decide(spans: list[dict], classifier: SpanClassifier, add_at: float) -> list[dict]:
    """Base spans, and others that are likely enough and overlap none already taken."""
    taken = [s for s in spans if s["base"]]
    starts, ends = [], []  # disjoint stretches that are taken, in order
    for s in sorted(taken, key=lambda s: s["start"]):
        if starts and s["start"] < ends[-1]:
            ends[-1] = max(ends[-1], s["end"])
        else:
            starts.append(s["start"])
            ends.append(s["end"])
    others = [(classifier.probability(s["kind"], s["votes"], s["shape"]), s)
              for s in spans if not s["base"] and not s["refuted"]]
    for p, s in sorted(others, key=lambda x: (-x[0], x[1]["start"], KINDS.index(x[1]["kind"]))):
        at = bisect_left(starts, s["end"])
        if p >= add_at and (not at or ends[at - 1] <= s["start"]):
            taken.append(s)
            starts.insert(at, s["start"])
            ends.insert(at, s["end"])
    return sorted(taken, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def written(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       add_at: float = ADD_AT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_email, n_ip, n_card, n_phone`` and
    ``base_sha256`` of the base spans, ``spans`` (all, as ``kind:start:end``, code points).

    A null or empty text has no spans.  Other columns are ignored; rows that share an id or a
    text are rows of their own.  Without any candidate nothing is learned and nothing added.
    """
    proposed = propose(docs, id_col, text_col)
    _, classifier = learn(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {f"n_{k}": [] for k in BASE_KINDS}
            digests, texts = [], []
            for spans in batch.column("spans").to_pylist():
                base = [s for s in spans if s["base"]]
                for k in BASE_KINDS:
                    columns[f"n_{k}"].append(sum(s["kind"] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                texts.append(written(decide(spans, classifier, add_at)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns.values()),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", *columns, "base_sha256", "spans"])

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE_KINDS),
                        "base_sha256 string", "spans string"])
    return proposed.mapInArrow(run, schema)
