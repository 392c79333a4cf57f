import hashlib
import random
import re

import pytest

from riskweave.llm import personal_data as P

from .conftest import TEXTS

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {"email": True,
                    "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19
                    and sum(x // 10 + x % 10 for x in double) % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base(text):
    return [(s.kind, s.start, s.end) for s in P.candidates(text) if s.base]


@pytest.mark.parametrize("letters", ["a@.", "a@.-1", "1.2 ", "12 -+().", "0123456789 -",
                                     "ab@c.d+1 2()", "1.", "é@a.b "])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        assert base(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        assert base(text) == []
    assert len(base("1." * 100_000)) == 25_000


def test_estimates_follow_planted_reliabilities():
    rng = random.Random(1)
    reliable = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        marks = "".join(("+" if y else "-") if rng.random() < r else ("-" if y else "+")
                        for r in reliable)
        counts["email", marks] = counts.get(("email", marks), 0) + 1
        truth.setdefault(marks, []).append(y)
    found = P.estimate(counts)
    assert abs(found.prior["email"] - 0.4) < 0.03
    for j, r in enumerate(reliable):
        assert abs(found.given[j]["+"][0] - r) < 0.05
    right = sum((found.posterior("email", m) >= 0.5) == y for m, ys in truth.items() for y in ys)
    assert right / 20_000 > 0.95


def test_documents(edge_docs, documents, texts, no_docs):
    for docs, rows in ((documents, texts), (edge_docs, TEXTS)):
        found = P.find_personal_data(docs).collect()
        want = []
        for i, text in rows:
            spans = brute(text)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())
            want.append((i, *(sum(s[0] == k for s in spans) for k in PATTERNS),
                         digest.hexdigest()))
        assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
        by_id = dict(rows)
        for r in found:  # base spans are among all spans
            listed = r["spans"].split(",")
            assert {f"{k}:{a}:{b}" for k, a, b in brute(by_id[r["doc_id"]])} <= {*listed, ""}
    assert P.find_personal_data(no_docs).collect() == []


def test_spans_beyond_the_base_kinds(spark):
    rows = [(i, f"word mail me: jane{i}@host{i}.com or call +1 (212) 555-{1000 + i} today")
            for i in range(60)]
    rows += [(100 + i, f"nothing 999.{i}.1.2 and version 1.2.{300 + i}.4 here") for i in range(60)]
    rows += [(200, "phone (212) 555-0199, ask for Mrs Mary Smith"), (201, "no 212 555 01 99")]
    found = {r["doc_id"]: r["spans"] for r in P.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "phone:6:20" in found[200] and found[201] == ""
    assert all(found[i].count(",") == 1 for i in range(60))
    assert not any(found[100 + i] for i in range(60))


def test_added_spans_do_not_overlap():
    mark = {"votes": "++++++", "shape": "44ss", "refuted": False}
    spans = [{"kind": "phone", "start": 5, "end": 9, "base": True, **mark},
             {"kind": "name", "start": 0, "end": 6, "base": False, **mark},
             {"kind": "name", "start": 9, "end": 12, "base": False, **mark}]
    sure = P.SpanClassifier([0.0] * len(P.features("name", "000000", "00ss")), 9.0)
    assert [(s["start"], s["end"]) for s in P.decide(spans, sure, 0.9)] == [(5, 9), (9, 12)]
    assert P.decide(spans, P.SpanClassifier(), 0.9) == spans[:1]


def test_planted_secrets(spark):
    """Keys and tokens are added, what only looks like some is not; base spans stay."""
    rng = random.Random(3)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    rows, planted = [], set()
    for i in range(400):
        before, after = (draw("abcdefgh ", rng.randint(0, 60)) for _ in range(2))
        kind = i % 8
        secret = [draw("0123456789abcdef", 40), "ghp_" + draw(mixed, 36),
                  "sk-" + draw(mixed, 48), draw("0123456789abcdef", 64)][kind % 4]
        line = f'{["token", "key", "secret", "password"][kind % 4]} = "{secret}"'
        if kind >= 4:
            line = [f"commit {draw('0123456789abcdef', 40)} checksum",
                    f"section-{rng.randint(1, 99)}-of-the-annual-report-20{rng.randint(10, 30)}",
                    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111", f"plain words {i} here"][kind - 4]
        text = f"{before} {line} {after} mail me@host{i}.org"
        rows.append((i, text))
        if kind < 4:
            planted.add((i, f"secret:{text.index(secret)}:{text.index(secret) + len(secret)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.find_personal_data(docs).collect()
    found = {(r["doc_id"], s) for r in got for s in r["spans"].split(",") if s[:6] == "secret"}
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found & planted) >= 0.9 * len(found)
    assert all(r["n_email"] == 1 and "email:" in r["spans"] for r in got)
