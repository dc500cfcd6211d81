import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, embed, fusion, late, rerank, sparse
from quarry.operators import queries as qt
from quarry.plans import queries

DOCS = [(0, "The cat sat on the mat with another cat"), (1, "Dogs chase the ball"), (2, "Python programming for data work"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, query string")


def test_bm25(spark, docs):
    found = sparse.search(sparse.build(docs), asked(spark, "cat mat", "Python programming", "cat cat mat", "nothing here"), 2).collect()
    best = {r.qid: r.id for r in found if r["rank"] == 1}
    assert best == {0: 0, 1: 2, 2: 0}
    lengths = [5, 3, 4, 0, 0]  # cat sat mat another cat | dogs chase ball | python programming data work
    idf = math.log((5 - 1 + 0.5) / 1.5 + 1)
    part = lambda tf: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 5 / (sum(lengths) / 5)))
    scores = {(r.qid, r.id): r.score for r in found}
    assert scores[0, 0] == pytest.approx(part(2) + part(1), abs=1e-6) and scores[2, 0] == pytest.approx(2 * part(2) + part(1), abs=1e-6)


def test_bm25_grows_and_reads_back(spark, docs, tmp_path):
    whole = sparse.build(docs)
    grown = sparse.add(sparse.build(docs.where("doc_id < 2")), docs.where("doc_id >= 2"))
    sparse.write(grown, str(tmp_path))
    for index in (grown, sparse.read(spark, str(tmp_path))):
        assert sorted(sparse.scores(index, asked(spark, "cat data")).collect()) == sorted(sparse.scores(whole, asked(spark, "cat data")).collect())


def vectors(spark, rows, name="vec_id"):
    rows = [(i, v and [float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(rows, f"{name} int, embedding array<float>")


def test_dense(spark, monkeypatch):
    rows = vectors(spark, [(0, [1.0, 0, 0, 0]), (1, [0.0, 1, 0, 0]), (2, [0.5, 0.5, 0, 0]), (3, [0.0, 0, 0, 0]), (4, [2.0, 0, 0, 0]), (5, None)])
    asks = vectors(spark, [(7, [1.0, 0, 0, 0]), (8, [0.0, 1, 0, 0])], "qid")
    got = lambda df: [(r.qid, r["rank"], r.id, round(r.score, 4)) for r in df.orderBy("qid", "rank").collect()]
    want = [(7, 1, 0, 1.0), (7, 2, 4, 1.0), (8, 1, 1, 1.0), (8, 2, 2, 0.7071)]
    assert got(dense.search(rows, asks, 2)) == want
    monkeypatch.setattr(dense, "QUERY_BYTES", 32)  # two blocks
    assert got(dense.search(rows, asks, 2)) == want
    assert got(dense.search(rows, asks.where("qid = 7"), 3, "l2")) == [(7, 1, 0, 0.0), (7, 2, 2, 0.5), (7, 3, 3, 1.0)]
    assert got(dense.search(rows, vectors(spark, [(1, [0.0, 0, 0, 0])], "qid"), 3, "chunk_cosine")) == []
    assert dense.search(rows.where("vec_id > 9"), asks, 3).count() == 0
    with pytest.raises(ValueError):
        dense.search(rows, asks, 1, "dot")
    with pytest.raises(Exception, match="4 components"):
        dense.search(vectors(spark, [(0, [1.0])]), asks, 1).collect()
    assert [r.vec_id for r in dense.remove(rows, rows.where("vec_id in (0, 1, 99)")).orderBy("vec_id").collect()] == [2, 3, 4, 5]
    assert dense.add(rows, rows).count() == 12


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, 1, 10, 0.9, "a"), (1, 0, 2, 11, 0.8, "b"), (1, 1, 1, 12, 0.95, "b"), (1, 1, 2, 13, 0.7, "c")], "qid int, list_no int, rank int, id int, score double, text string")
    found = fusion.reciprocal_rank(lists).orderBy("rank").collect()
    assert [(r.text, r.id) for r in found] == [("b", 12), ("a", 10), ("c", 13)]
    assert found[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.text for r in fusion.reciprocal_rank(lists, weights=(10, 1)).orderBy("rank").collect()][:2] == ["b", "a"]
    assert {r.text for r in fusion.reciprocal_rank(lists, weights=(1,)).collect()} == {"a", "b"}


def test_late(spark):
    tokens = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0])], "id int, vec array<double>")
    asks = spark.createDataFrame([(5, 0, [1.0, 0.0, 0.0]), (5, 1, [0.0, 1.0, 0.0])], "qid int, qpos int, qvec array<double>")
    assert [(r.id, r.score) for r in late.search(tokens, asks).orderBy("rank").collect()] == [(0, 2.0), (1, 0.0)]


def test_encoders(spark, docs):
    encoder = embed.HashingEncoder(64)
    rows = embed.embed(docs, encoder).collect()
    assert all(len(r.embedding) == 64 for r in rows) and sum(x * x for x in rows[0].embedding) == pytest.approx(1) and not any(rows[4].embedding)
    words = embed.token_vectors(docs, "doc_id", dimension=8).collect()
    assert {r.doc_id for r in words} == {0, 1, 2, 3, 4} and sum(x * x for x in words[0].vec) == pytest.approx(1)
    custom = embed.ModelEncoder(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2, normalize=False)
    assert {tuple(r.embedding) for r in embed.embed(docs, custom).collect()} >= {(19.0, 1.0), (0.0, 1.0)}


def test_late_on_a_grid(spark, monkeypatch):
    import random

    rng = random.Random(1)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]
    tokens = spark.createDataFrame([(i % 7, vec()) for i in range(60)], "id int, vec array<double>").repartition(3)
    asks = spark.createDataFrame([(q, p, vec()) for q in range(5) for p in range(3)], "qid int, qpos int, qvec array<double>")
    whole = sorted(map(tuple, late.search(tokens, asks).collect()))
    for limit in ("QUERY_BYTES", "ROW_BYTES", "CELLS"):
        monkeypatch.setattr(dense, limit, 100)
    assert sorted(map(tuple, late.search(tokens, asks).collect())) == whole
    rows = tokens.selectExpr("monotonically_increasing_id() as vec_id", "vec as embedding")
    pairs = dense.pair_similarity(rows, rows).collect()
    assert len(pairs) == 3600 and all(r.sim <= 1 for r in pairs)


def test_missing_models_and_fallbacks(spark, docs):
    with pytest.raises(Exception, match="sentence_transformers"):
        embed.embed(docs, embed.sentence_model("any", 3)).collect()
    plain = embed.ModelEncoder(lambda: lambda texts: [[len(t), 1.0, 0.0] for t in texts], 3, normalize=False)
    assert embed.embed(docs, embed.Fallback(embed.sentence_model("any", 3), plain)).where("doc_id = 0").first()["embedding"][2] == 0

    class Client:
        class embeddings:
            @staticmethod
            def create(input, model):
                from types import SimpleNamespace as N

                assert len(input) <= 2 and not any("\n" in t for t in input)
                return N(data=[N(embedding=[float(len(t)), 1.0]) for t in input])

    far = embed.hosted(batch=2, dimension=2, connect=Client)
    assert len(embed.embed(docs, far).where("doc_id = 0").first()["embedding"]) == 2

    def model(prompt):
        if "passage" in prompt:
            raise RuntimeError
        return prompt.upper()

    made = [r.hypothesis for r in qt.imagined(lambda: model)(asked(spark, "cat")).orderBy("h").collect()]
    assert made[0] == "CAT" and made[2] == "A passage about the following topic: cat"


def test_hybrid_and_hyde(spark, docs):
    encoder = embed.HashingEncoder()
    stored = embed.embed(docs.where("text is not null"), encoder)
    asks = embed.embed(asked(spark, "cat on a mat"), encoder, "query")
    assert fusion.hybrid(stored, sparse.build(stored), asks, 2).where("rank = 1").first()["id"] == 0
    made = qt.hypotheses(asks, 2).collect()
    assert len(made) == 2 and all("cat on a mat" in r.hypothesis for r in made)
    assert qt.hyde_search(stored, asks.select("qid", "query"), encoder, 1).first()["id"] == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "cat mat", 1, 10, "dog", 0.9), (1, "cat mat", 2, 11, "a cat", 0.5), (1, "cat mat", 3, 12, "cat mat", 0.1)], "qid int, query string, rank int, id int, text string, score double")
    found = rerank.rerank(hits, 2).orderBy("rank").collect()
    assert [(r.id, r.score, r.original_score) for r in found] == [(12, 1.0, 0.1), (11, 0.5, 0.5)]
    scorer = rerank.model(lambda: lambda q, t: [[0.0, float(len(x))] for x in t])
    assert rerank.rerank(hits, 1, scorer).first()["id"] == 12
    assert rerank.rerank(hits.limit(0)).count() == 0


def test_bm25_add_reads_null_languages(spark, tmp_path):
    rows = [(1, "red apple", "en"), (2, "red pear tree", "de"), (3, "red plum", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "red plum")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {name: {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("bm25_add", "bm25_topk")}
    assert found["bm25_add"] == found["bm25_topk"] and {r[2] for r in found["bm25_add"]} == {1, 2, 3}
