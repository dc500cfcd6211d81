import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_of_odd_rows(docs, odd):
    found = quality.judge(docs).collect()
    want = sorted(((i is None, i or 0, *plain(t)) for i, t, _, _ in odd))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a a", "#x $y <z>\n\n#x $y <z>\n", "  lead\nlead\n  lead", "é ü\u2003z"])
def test_counts_of_texts(text):
    assert quality.counts_of(text.encode()) == plain(text)


def test_outliers_go_and_plain_rows_stay(spark):
    import random

    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{k}$%#*{k * 7}" for k in range(100 + i)), "en", f"s{i % 3}") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300))
    assert not any(kept[1000 + i] for i in range(5))


def least_determinant(groups, steps=quality.STEPS):
    """(mean, covariance, logarithm of its determinant, start) of each (lang, source), by plain arrays of all rows."""
    lean = {}
    runs = {}
    for key, x in groups.items():
        mid = np.median(x, 0)
        sd = np.sqrt(((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2 + np.square(quality.FLOORS))
        gap = (x - mid) / sd
        signs = mid + sd * gap / np.maximum(np.linalg.norm(gap, axis=1, keepdims=True), 1e-12)
        runs[key] = [(mid, np.diag(sd**2)), x, signs]

    def estimates(parts):
        out = {}
        for key, some in parts.items():
            every = np.concatenate([v for k, v in parts.items() if k[0] == key[0]])
            part = len(some) / (len(some) + quality.PRIOR)
            cov = lambda v: np.cov(v.T, bias=True)
            gap = some.mean(0) - every.mean(0)
            c = part * cov(some) + (1 - part) * cov(every) + part * (1 - part) * np.outer(gap, gap)
            c = c * quality.CONSISTENCY + np.diag(np.square(quality.FLOORS))
            out[key] = part * some.mean(0) + (1 - part) * every.mean(0), c
        return out

    for start in range(3):
        now = estimates({k: r[start] for k, r in runs.items()}) if start else {k: r[0] for k, r in runs.items()}
        for _ in range(steps):
            near = {}
            for key, x in groups.items():
                d = np.einsum("ri,ij,rj->r", x - now[key][0], np.linalg.inv(now[key][1]), x - now[key][0])
                bins = np.floor(np.log(d + 1e-6) * 64)
                near[key] = x[bins <= np.sort(bins)[int(np.ceil(quality.COVER * len(x))) - 1]]
            now = estimates(near)
        for key, (mean, c) in now.items():
            if key not in lean or np.linalg.slogdet(c)[1] < lean[key][2]:
                lean[key] = mean, c, np.linalg.slogdet(c)[1], start
    return lean


def test_distances_are_those_of_least_determinant(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lang, source, n, part in (("en", "a", 400, 0.3), ("en", "b", 60, 0.0), ("de", "a", 200, 0.2), (None, None, 30, 0.1), ("de", "tiny", 2, 0.0)):
        for i in range(n):
            odd = rng.random() < part
            dup, words = int(rng.integers(0, 3)), int(rng.integers(60, 300))
            rows.append((len(rows), lang, source, words, int(words * rng.normal(9 if odd else 5, 0.4)), int(rng.integers(20, 60) if odd else rng.integers(0, 4)), dup * 4 if odd else dup, int(rng.integers(0, words // 4))))
    df = spark.createDataFrame(rows, "id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint").withColumns(dict(zip(quality.X, quality.vector())))
    groups = {}
    for r in df.collect():
        groups.setdefault((r.lang, r.source), []).append([r[x] for x in quality.X])
    want = least_determinant({k: np.array(v) for k, v in groups.items()})
    found = quality.robust(df.select(*quality.GROUP, *quality.X)).collect()
    assert len(found) == len(want)
    for r in found:
        mean, c, _, _ = want[r.lang, r.source]
        p = np.zeros((4, 4))
        for i, j in quality.PAIRS:
            p[i, j] = p[j, i] = r[f"p_{i}_{j}"] / (1 if i == j else 2)
        # medians of the start come from bins of 1/128
        assert np.allclose([r[f"m{i}"] for i in range(4)], mean, atol=0.05)
        assert np.allclose(np.linalg.inv(p), c, rtol=0.1, atol=0.05)


def test_other_starts_reach_lesser_determinants(spark):
    """Three quarters of the rows on a line that quartiles of single statistics can't see."""
    rng = np.random.default_rng(9)
    t = rng.normal(size=600) * 4
    x = np.stack([t, t, rng.normal(size=600), rng.normal(size=600)], 1)
    x[::5, 1] = -x[::5, 1] * 2
    lean = least_determinant({("en", "a"): x})["en", "a"]
    one = least_determinant({("en", "a"): x}, steps=0)["en", "a"]
    assert lean[2] < one[2]
    found = quality.robust(spark.createDataFrame([("en", "a", *map(float, r)) for r in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")).first()
    p = np.array([[found[f"p_{min(i, j)}_{max(i, j)}"] / (1 if i == j else 2) for j in range(4)] for i in range(4)])
    assert -np.linalg.slogdet(p)[1] == pytest.approx(lean[2], abs=0.1)


def test_equal_rows_get_equal_verdicts_and_no_rows_none(docs, none):
    assert quality.judge(docs).groupBy("doc_id").agg(F.count_distinct("distance2").alias("n")).where("n > 1 and doc_id is not null").isEmpty()
    assert quality.judge(none).count() == 0
