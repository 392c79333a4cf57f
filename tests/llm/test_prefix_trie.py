import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import prefix_trie as trie

COLUMNS = ("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens "
           "ends_sha256").split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every prefix spelt out."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(),
                             (text or "").encode()))
    turns = {c: [(r, t.decode()) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, of in members.items():
        below = [q for q in members if q[:len(path)] == path]
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of),
            len(children[path]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS)
                   for r in trie.prefix_trie(table, **options).collect()), key=str)


def some_rows(seed, ids, longest=9, words=2):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]),
             rng.choice(["", None, "a", "é🙂", "word " * 9][:words + 1]))
            for c in ids for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("words", [1, 2, 4])
def test_against_brute_force(spark, words):
    rows = some_rows(words, [*range(40), *range(100, 130), 250, 251, -1, -5, -100, -150], 9, words)
    assert found(spark, rows) == brute(rows)


def test_copies_and_a_long_conversation(spark):
    """A conversation over many tasks, copies of it, and one that owns most rows."""
    rows = [(c, t, "user", f"turn {t % 7}") for c in (0, 3, 50, 200, 201) for t in range(120)]
    rows += [(c, t, "user", "hello") for c in range(300, 360) for t in range(2)]
    assert found(spark, rows, parts=7) == brute(rows)


def test_rows_without_ids_repeated_rows_and_ties(spark):
    rows = [(None, 0, "user", "left out"), (7, 1, "b", "y"), (7, 1, "a", "z"), (7, 1, "a", "x"),
            (7, 1, "a", "x"), (7, None, None, None), (5, 1700000000000, "a", "x"), (107, 0, "a", "")]
    assert found(spark, rows) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 160)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[-1] != hashlib.sha256().hexdigest() for r in got)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0
    rows = some_rows(3, range(20))
    table = spark.createDataFrame(rows, SCHEMA)
    for clash in ("pos", "f1", "depth", "n", "base", "head", "heads", "total", "conv_id_", "part"):
        table = table.withColumn(clash, F.lit("x"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table).collect()),
                 key=str)
    assert got == brute(rows)


def test_long_text(spark):
    rows = [(c, t, "user", "é" * 300_000 + str(t)) for c in (1, 2, 100) for t in range(3)]
    assert found(spark, rows) == brute(rows)


def test_collisions_are_found(spark, monkeypatch):
    """Turns of two fingerprints only: the first attempt must be refused."""
    rows = some_rows(5, range(30), words=4)
    refused = []
    check = trie.unequal
    monkeypatch.setattr(trie, "unequal", lambda *a: refused.append(check(*a)) or refused[-1])
    assert found(spark, rows, bits=1) == brute(rows)
    assert refused == [True, False]


def test_products_compose():
    z = trie.multipliers(1)[0]
    turns = [5, 7, 11, 13, 17]

    def product(t):
        value, power = 0, 1
        for x in t:
            power = power * z % trie.PRIME
            value = (value + x * power) % trie.PRIME
        return value

    whole = product(turns)
    suffix = (whole - product(turns[:2])) * pow(z, -2, trie.PRIME) % trie.PRIME
    assert suffix == product(turns[2:])
    assert (product(turns[:2]) + pow(z, 2, trie.PRIME) * product(turns[2:])) % trie.PRIME == whole
