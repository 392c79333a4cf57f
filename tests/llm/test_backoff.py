import math
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import backoff as B

from .conftest import TEXTS
from .test_positional_index import words


def brute(rows, order, alpha=0.4):
    split = [words(t) for _, t in rows]
    own = [Counter(tuple(w[j - n + 1:j + 1]) for j in range(len(w))
                   for n in range(1, min(order, j + 1) + 1)) for w in split]
    total, size = Counter(), sum(map(len, split))
    for counts in own:
        total.update(counts)
    out = []
    for (i, _), w, mine in zip(rows, split, own):
        score, full, unseen = 0.0, 0, 0
        for j in range(len(w)):
            most = min(order, j + 1)
            for n in range(most, 0, -1):
                gram = tuple(w[j - n + 1:j + 1])
                if total[gram] > mine[gram]:
                    before = total[gram[:-1]] - mine[gram[:-1]] if n > 1 else size - len(w)
                    score += math.log((total[gram] - mine[gram]) / before)
                    score += (most - n) * math.log(alpha)
                    full += n == order
                    break
            else:
                unseen += 1
                score += most * math.log(alpha) - math.log(size - len(w) + 1)
        out.append((i, len(w), score, full, unseen))
    return sorted(out, key=str)


def assert_scores(found, want):
    rows = sorted(((r["doc_id"], r["n_words"], r["log_score"], r["n_full"], r["n_unseen"])
                   for r in found), key=str)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [(r[0], r[1], r[3], r[4]) for r in want]
    assert np.allclose([r[2] for r in rows], [r[2] for r in want], rtol=1e-9)


@pytest.mark.parametrize(("order", "options"), [
    (3, {}), (1, {"block_bytes": 5000, "range_entries": 900}),
    (2, {"block_bytes": 20_000}), (4, {"block_bytes": 30_000, "range_entries": 5000})])
def test_scores_equal_brute_force(documents, texts, order, options):
    some = documents.where("doc_id < 80")
    rows = [(i, t) for i, t in texts if i < 80]
    assert_scores(B.backoff_scores(some, order=order, **options).collect(), brute(rows, order))


def test_odd_rows(edge_docs, no_docs):
    rows = [r for r in TEXTS if not r[1] or len(r[1]) < 1000]
    some = edge_docs.where("text IS NULL OR length(text) < 1000")
    assert_scores(B.backoff_scores(some, block_bytes=60).collect(), brute(rows, 3))
    assert B.backoff_scores(no_docs).collect() == []
    long = [r for r in B.backoff_scores(edge_docs).collect() if r["doc_id"] in (7, 8)]
    assert [(r["n_words"], r["n_full"]) for r in long] == [(60_000, 59_998)] * 2


def test_packing():
    rng = np.random.default_rng(2)
    for top in (0, 255, 256, 1 << 40, (1 << 56) - 1):
        values = rng.integers(0, top + 1, 500).astype(np.uint64)
        assert (B.widen(*B.narrow(values)) == values).all()


def test_hash_ranges_cover_all():
    for parts in (1, 3, 7, 1000):
        limits = B.bounds(parts)
        assert limits[0] == 0 and int(limits[-1]) == 1 << B.HASH_BITS
        assert (np.diff(limits.astype(float)) > 0).all()
