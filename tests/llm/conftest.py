import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, blob string, bucket int, part int, n bigint, shard string, kept string, weight string"


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "  \n\t ", "word", "two words", "three word text", base, base, " ".join(near), base.upper(), text(80) + " " + passage, passage + " " + text(90), "x" * 200_000, "ab " * 30_000, "Ünïcode straße 日本語 " * 30, text(200) + "\n" + text(3) + "\n" + text(3), "\u2028" + text(70), passage]
    texts += [text(rng.randint(40, 150)) for _ in range(30)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None), (None, text(70), "en", "a"), (9_000_000_000, passage + " " + passage, "en", "a"), (-5, base + " " + passage, "de", "b")]
    return rows


@pytest.fixture(scope="session")
def odd():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, odd):
    """The odd rows, with extra columns whose names operators may use within."""
    return spark.createDataFrame([(i, t, lang, source, None, "x", "y", 1, 2, 3, "z", "w", "v") for i, t, lang, source in odd], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
