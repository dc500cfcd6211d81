import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_scores
from quarry.llm.packed import dump, load


def plain(rows, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    every = {n: sum((grams(t, n) for t in docs), Counter()) for n in range(1, order + 1)}
    total = sum(map(len, docs))
    out = []
    for (i, _), t in zip(rows, docs):
        own = {n: grams(t, n) for n in every}
        c = lambda g: every[len(g)][g] - own[len(g)][g]  # noqa: E731, B023
        score = 0.0
        for k, w in enumerate(t):
            h = tuple(t[max(0, k - order + 1) : k])
            while h and not c((*h, w)):
                h, score = h[1:], score + math.log(lm_scores.BACKOFF)
            if h:
                score += math.log(c((*h, w)) / c(h))
            else:
                rest = total - len(t)
                score += math.log(c((w,)) / rest) if c((w,)) else -math.log(2 * rest + 2)
        out.append((i is None, i or 0, len(t), round(score, 5)))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(docs, odd, order):
    found = lm_scores.score(docs, order=order).collect()
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.score, 5)) for r in found)
    want = plain([r[:2] for r in odd], order)
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in want], abs=1e-4, rel=1e-9)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in found)


def test_small_blocks_agree_with_large_ones(docs, monkeypatch):
    large = {(r.doc_id, r.n_words, round(r.score, 6)) for r in lm_scores.score(docs).collect()}
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", 500)
    assert {(r.doc_id, r.n_words, round(r.score, 6)) for r in lm_scores.score(docs).collect()} == large


def test_no_rows_and_wrong_order(none, docs):
    assert lm_scores.score(none).count() == 0
    with pytest.raises(ValueError):
        lm_scores.score(docs, order=1)


def test_totals_beyond_32_bits(spark):
    most = 2**32 - 1
    rows = [(0, block, dump([np.array([3, 5], np.uint64), np.array([most, block], np.uint32)])) for block in (1, 2, 3)]
    sent = spark.createDataFrame([(b, n, bytearray(x)) for b, n, x in rows], "bucket int, block bigint, blob binary")
    found = {r.block: load(bytes(r.blob))[0].tolist() for r in lm_scores._answer(sent, 1).collect()}
    assert found == {1: [2 * most, 5], 2: [2 * most, 4], 3: [2 * most, 3]}
    words = lm_scores.Words(np.array([3, 5], np.uint64), np.array([0, 3]), np.array([0, 1, 0]), [np.array([2 * most, 5], np.uint64)])
    again = lm_scores.Words.unpacked(words.packed())
    assert again.totals[0].tolist() == [2 * most, 5] and again.others(1).tolist() == [2 * most, 5, 2 * most]
