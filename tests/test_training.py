import random

import numpy as np
import pytest

from quarry.operators import dense, embed, late
from quarry.plans import training

WORDS = [f"topic{i}" for i in range(40)]


def rows(spark):
    rng = random.Random(2)
    noise = lambda: " ".join(f"n{rng.randint(0, 30)}" for _ in range(2))
    return spark.createDataFrame([(f"ask {w} {noise()}", f"reply {w[::-1]} {noise()}") for w in WORDS for _ in range(8)] + [(None, "x")], "query string, positive string")


def test_fitting_brings_pairs_together(spark, tmp_path):
    seen = []

    class Count(training.Callback):
        def epoch_end(self, state):
            seen.append(state.epoch)

    encoder, state = training.fit(rows(spark), embed.HashingEncoder(512), 64, training.Arguments(epochs=30, rate=0.5), [Count(), training.EarlyStopping(5), training.SaveBest(str(tmp_path / "w.npy"))])
    assert len(seen) == len(state.history) <= 30 and state.history[-1][0] < state.history[0][0]
    assert np.load(tmp_path / "w.npy").shape == (512, 64)
    docs = spark.createDataFrame([(i, f"reply {w[::-1]}") for i, w in enumerate(WORDS)], "vec_id int, text string")
    asks = spark.createDataFrame([(i, f"ask {w}") for i, w in enumerate(WORDS)], "qid int, query string")
    right = lambda e: sum(r.id == r.qid for r in dense.search(embed.embed(docs, e), embed.embed(asks, e, "query"), 1).collect())
    assert right(encoder) >= 30 > right(embed.HashingEncoder(512))


def test_stops_early_and_needs_pairs(spark):
    _, state = training.fit(rows(spark), None, 8, training.Arguments(epochs=9, rate=0.0), [training.EarlyStopping(2)])
    assert len(state.history) == 3 and state.stop
    with pytest.raises(ValueError):
        training.fit(rows(spark).limit(0))


def test_token_models(spark):
    docs = spark.createDataFrame([(0, "a bb ccc"), (1, "bb"), (2, None)], "id int, text string")
    load = lambda: lambda texts: [np.array([[len(w), 1.0] for w in t.split()] or [[1.0, 0.0]]) for t in texts]
    made = embed.token_model(docs, load, most=2)
    assert sorted((r.id, r.pos) for r in made.collect()) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    asks = embed.token_model(docs.where("id = 1"), load).selectExpr("id as qid", "pos as qpos", "vec as qvec")
    assert late.search(made.select("id", "vec"), asks, 1).first()["score"] == pytest.approx(1)
    with pytest.raises(Exception, match="transformers"):
        embed.token_model(docs, embed.transformer_tokens("any")).collect()
