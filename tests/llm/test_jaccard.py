import re

import pytest

from quarry.llm import jaccard


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return out


def plain(rows, percent=70):
    sets = sets_of(rows)
    near = {a: {b for b in sets if b != a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])} for a in sets}
    out = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (len(sets[a]), len(near[a]), min(seen))
    return out


def found(df):
    return {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("percent", [70, 50])
def test_odd_rows(docs, odd, percent):
    known = docs.where("doc_id is not null")
    result = jaccard.link(known, percent=percent)
    assert found(result) == plain([r[:2] for r in odd if r[0] is not None], percent)
    assert result.count() == known.count()


def test_chains_and_hot_groups(spark):
    import random

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(100)]
    rows = []
    for i in range(40):  # a chain in which only neighbours are near
        words = list(base)
        words[: i * 6] = [f"c{i}x{k}" if k >= (i - 1) * 6 else f"c{k // 6 + 1}x{k}" for k in range(i * 6)][:100]
        rows.append((i, " ".join(words[:100])))
    rows += [(1000 + i, " ".join(base[:50] + [f"u{i}"] + base[51:])) for i in range(60)]  # near copies
    rows += [(2000 + i, "same text in many places " * 9) for i in range(80)]  # exact copies
    rows += [(3000 + i, " ".join(base[:60]) + " " + " ".join(f"z{i}y{k}" for k in range(90))) for i in range(50)]  # a shared passage
    assert found(jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_long_lists_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # many sizes, all with shingles in common
        words = base[: rng.randint(30, 60)]
        words[rng.randrange(len(words))] = f"u{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "PAIRS_A_LIST", 20)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 16)
    for percent in (70, 50):
        assert found(jaccard.link(df, percent=percent)) == plain(rows, percent)


def test_pairs_of_a_large_cluster_are_not_made(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):  # near copies of one text, some farther from it
        words = list(base)
        for k in rng.sample(range(300), rng.choice([1, 2, 3, 4, 12, 20, 30])):
            words[k] = f"u{i % 90}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # copies of near copies
    rows += [(2000 + i, " ".join(base[:200]) + " " + " ".join(f"o{i // 3}y{k}" for k in range(100))) for i in range(60)]  # outside, in part alike
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(jaccard, "SAMPLED", 8)
    made = []
    listed = jaccard._group_pairs
    monkeypatch.setattr(jaccard, "_group_pairs", lambda *a: made.append(listed(*a).cache()) or made[-1])
    for a_list, block, bit in ((jaccard.PAIRS_A_LIST, 100, 1), (20, 4000, 32)):  # pairs of a cell and the rest of a list at once and in jobs; cells in blocks and whole
        monkeypatch.setattr(jaccard, "PAIRS_A_LIST", a_list)
        monkeypatch.setattr(jaccard, "CELL_BLOCK", block)
        monkeypatch.setattr(jaccard, "BIT_FROM", bit)
        assert found(jaccard.link(df)) == plain(rows)
        assert made.pop().count() < 400 * 399 / 2 / 2
    monkeypatch.setattr(jaccard, "SAMPLED", 1 << 40)  # without centers all pairs are made, with the same result
    assert found(jaccard.link(df)) == plain(rows)
    assert made.pop().count() > 400 * 399 / 2 / 2
    cells = jaccard.Cells([np.arange(1, 101, dtype=np.uint64)])
    assert [cells.of(np.arange(1, 101 - k, dtype=np.uint64)) for k in (0, 50, 51)] == [1, 1, 0]


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n"), (4, "o p q r")]
    got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    # each row links as its text does; rows of one id are one document of a text's copies
    assert got == [(1, 5, 1, 1), (1, 5, 1, 1), (2, 5, 1, 1), (3, 5, 1, 1), (4, 2, 0, 4)]


def test_null_ids_do_not_break(docs, odd):
    rows = jaccard.link(docs).collect()
    assert len(rows) == len(odd)
    copy, own = sorted((r for r in rows if r.doc_id is None), key=lambda r: r.component_id is None)
    assert copy.component_id == 6 and own.component_id is None and own.n_similar == 0


def test_differing_bounds_the_difference():
    import random

    import numpy as np

    rng = random.Random(0)
    for _ in range(200):
        a, b = ({rng.getrandbits(63) for _ in range(rng.randint(1, 300))} for _ in range(2))
        b |= set(list(a)[: rng.randint(0, len(a))])
        sig = lambda s: jaccard._parity(np.array(sorted(s), np.uint64))
        assert jaccard.differing(sig(a), sig(b)) <= len(a ^ b)


def test_no_rows(none):
    assert jaccard.link(none).count() == 0
