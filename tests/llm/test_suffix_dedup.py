import hashlib
from collections import Counter

import pytest

from quarry.llm import suffix_dedup

LAST = 2**63 - 1


def plain(rows):
    first = {}
    for i, t in rows:
        o = LAST if i is None else i
        b = (t or "").encode()
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            first[g] = min(first.get(g, LAST), o)
    out = Counter()
    for i, t in rows:
        o, b = LAST if i is None else i, (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < o:
                mark[k : k + 50] = b"\1" * 50
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        out[i, len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest()] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_odd_rows(docs, odd):
    assert found(suffix_dedup.dedup(docs)) == plain([r[:2] for r in odd])


def test_repeated_ids_with_other_texts(spark):
    """Ids that repeat, where a result of one text must not touch the other."""
    import random

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    a, b, c = some(70), some(55), some(49)
    rows = [(1, a + some(30)), (2, some(10) + a), (2, some(40) + b), (2, a + b), (3, b + c + a), (3, c + c), (None, a + c), (None, b), (4, "z" * 120), (5, "z" * 90), (5, "z" * 49)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(suffix_dedup.dedup(df)) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    import random

    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    assert found(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id int, text string"))) == plain(rows)


def test_kept_bytes(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "é" + text + "ü")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(df, keep=True).collect()}
    assert kept == {1: text.encode(), 2: "éü".encode()}


def test_no_rows_and_wrong_ids(none, docs):
    assert suffix_dedup.dedup(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, id_col="lang")


def test_rows_grow_with_tasks_not_with_groups(spark, monkeypatch):
    """Matches of all groups that a task sorts travel together: a row for each task and part of the documents."""
    import random

    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    passages = [some(rng.randint(55, 90)) for _ in range(60)]
    rows = [(i, some(40) + passages[i % 60] + some(40)) for i in range(180)]
    tables = {}
    kept = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: tables.setdefault(name, kept(df, name)))
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 1)
    monkeypatch.setattr(suffix_dedup, "exchange_partitions", lambda spark, times=1: 2 * times)  # 4 buckets, 2 parts
    assert found(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)
    assert 0 < tables["suffixes"].where("kind = 2").count() <= 4 * 2
