import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunking


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def rows(df):
    return [(r.doc_id, r.chunk_index, r.text) for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_fixed(spark):
    df = frame(spark, "abcdefghij" * 2, "", None, " " * 12 + "end")
    assert rows(chunking.fixed(df, size=10, overlap=0)) == [(0, 0, "abcdefghij"), (0, 1, "abcdefghij"), (3, 0, "  end")]
    assert len(rows(chunking.fixed(df.where("doc_id = 0"), size=10, overlap=5))) == 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=120), st.integers(1, 30))
def test_recursive_parts_fit_and_keep_their_letters(text, size):
    parts = chunking.split_recursively(text, size)
    assert all(0 < len(p) <= size for p in parts)
    keep = lambda t: t.replace(" ", "").replace("\n", "").replace(".", "")
    assert keep("".join(parts)) == keep(text)


def test_recursive_overlap(spark):
    found = rows(chunking.recursive(frame(spark, "aaaa bbbb cccc dddd", "short", ""), size=9, overlap=3))
    assert found == [(0, 0, "aaaa bbbb"), (0, 1, "bbbcccc dddd"), (1, 0, "short")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=20), st.integers(10, 80), st.integers(0, 2))
def test_sentence_ranges_cover_all(lengths, size, overlap):
    ranges = chunking.pack_sentences(lengths, size, overlap)
    assert sorted({i for a, b in ranges for i in range(a, b + 1)}) == list(range(len(lengths)))
    assert all(a <= b for a, b in ranges) and all(x[1] < y[1] for x, y in zip(ranges, ranges[1:]))


def test_sentences(spark):
    found = rows(chunking.by_sentence(frame(spark, "First one. Second one. Third one. Fourth one."), size=24, overlap=1))
    assert found == [(0, 0, "First one. Second one."), (0, 1, "Second one. Third one."), (0, 2, "Third one. Fourth one.")]


def test_semantic(spark):
    text = "Cats purr at night. Cats purr at noon. Cats purr at dawn. Stocks fell hard today. Stocks fell hard again. Stocks fell hard anew."
    found = rows(chunking.semantic(frame(spark, text, "", "Single."), least=10, most=200))
    assert [r[2] for r in found if r[0] == 0] == ["Cats purr at night. Cats purr at noon. Cats purr at dawn.", "Stocks fell hard today. Stocks fell hard again. Stocks fell hard anew."]
    assert [r[2] for r in found if r[0] == 2] == ["Single."]
    assert chunking.settle_sizes(["ab", "cd", "long enough", "x"], 4, 100) == ["ab cd", "long enough x"]


def test_preprocess(spark):
    with pytest.raises(ValueError):
        chunking.preprocess(frame(spark, "x"), "other")
    assert rows(chunking.preprocess(frame(spark, "too short", "long enough to stay here"), "fixed")) == [(1, 0, "long enough to stay here")]
