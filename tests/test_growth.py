"""What must not grow with the tables beyond their own rows, and results that a shorter way must not lose."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import batches
from quarry.functions import vectors as vx
from quarry.operators import chunking, dense, embed, fusion, graph, metrics, sparse
from quarry.plans import queries


def hub(spark, n=30):
    """A chunk for each of n names, beside one name of all."""
    return spark.createDataFrame([(i, f"Then Hub uses Name{chr(97 + i // 26)}{chr(97 + i % 26)} well.") for i in range(n)], "chunk_id int, text string")


def test_queries_walk_the_graph_as_bits(spark):
    g = graph.build(hub(spark))
    start = spark.range(100).select(F.col("id").alias("qid"), F.lit("hub").alias("entity"))
    queries, count, fronts = graph._walk(g, start, 2)
    rows = sum(f.count() for f in fronts)
    found = graph.reach(g, start)
    assert count == 100 and found.count() == 100 * found.select("entity").distinct().count()
    assert rows <= 2 * found.select("entity").distinct().count()  # a row an entity and 64 queries
    asked = start.select("qid", F.lit("then name it").alias("query"))
    hits = graph.search(g, asked, 3, start=start).collect()
    assert {(r.qid, r.rank, r.id, r.score) for r in hits} == {(q, i + 1, i, 1.0) for q in range(100) for i in range(3)}


def test_every_entity_of_a_word_is_a_seed(spark):
    chunks = spark.createDataFrame([(1, "We saw Potsdam, Potsdamer Platz, Neupotsdam and Altpotsdam near Berlin. The OT."), (2, "Then Unterpotsdam.")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "where is potsdam"), (2, "where is nothing")], "qid int, query string")
    found = {(r.qid, r.entity) for r in graph.seeds(graph.build(chunks), asked).collect()}
    assert found == {(1, "potsdam"), (1, "potsdamer platz"), (1, "neupotsdam"), (1, "altpotsdam"), (1, "then unterpotsdam"), (1, "unterpotsdam"), (1, "potsdamer"), (1, "ot"), (2, "ot")}


def test_pages_read_as_their_sql_does(spark, tmp_path):
    pages = ["<p>a &amp; b</p> cut &amp", "&times; &amp;lt; &nbsp;&#x41; \u2003 x", "<style>a<script>b</style>c</script>d<b", "<SCRIPT x>\n</script >e</script> f&nbsp;", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(queries.SQL["html_text"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["html_text"](spark, str(tmp_path)).collect())) == sorted(want)


def test_a_large_set_of_queries_is_split_as_well(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    asked = rows.withColumnRenamed("vec_id", "qid")
    whole = sorted(map(tuple, dense.search(rows, asked, 5).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 100)
    monkeypatch.setattr(dense, "ROW_BYTES", 100 * 3 * 8)
    met = []

    def meet(given, held):
        yield pa.record_batch([pa.array([given.num_rows * held.num_rows], pa.int64())], ["n"])

    stored = rows.selectExpr("vec_id as id", "embedding as v")
    each = dense.in_blocks(stored, asked.selectExpr("qid", "embedding as v"), 400 * 24, "n bigint", meet)
    met = each.withColumn("p", F.spark_partition_id()).groupBy("p").sum("n").collect()
    assert sum(r[1] for r in met) == 400 * 400 and len(met) == 16 and max(r[1] for r in met) < 400 * 400 / 8
    assert sorted(map(tuple, dense.search(rows, asked, 5).collect())) == whole


@pytest.mark.parametrize("kind", ["normal", "equal", "few", "zero", "near"])
def test_single_precision_loses_no_neighbour(kind, monkeypatch):
    monkeypatch.setattr(dense, "WIDE", 64)
    monkeypatch.setattr(dense, "CELLS", 1 << 10)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 8))
    if kind == "equal":
        v[:] = v[0]
    elif kind == "few":
        v = v[rng.integers(0, 7, 500)] * rng.uniform(0.1, 10, 500)[:, None]
    elif kind == "zero":
        v[::2] = 0
    elif kind == "near":
        v = v[0] + rng.normal(size=v.shape) * 1e-4
    asked, order = v[:40], rng.permutation(500)
    sorted_ = lambda found: sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found))))
    got = sorted_(dense._nearest(asked, v, order, 5, 6))
    want = sorted_([(q, n, x) for q, n, x in dense._compared(asked, v, order, 5, "cosine", 6)])
    assert [(q, n) for q, n, _ in got] == [(q, n) for q, n, _ in want] and np.allclose([x for *_, x in got], [x for *_, x in want], rtol=0, atol=1e-9)


def test_relevance_by_class_lists_no_pairs(spark):
    items = spark.createDataFrame([(i, i % 3 if i != 5 else None) for i in range(12)], "id int, label int")
    asked = spark.createDataFrame([(0, 0), (4, 1), (5, None), (50, 2), (60, 9)], "qid int, label int")
    pairs = asked.join(items, "label").where("qid <> id").select("qid", "id")
    ranking = spark.createDataFrame([(q, r + 1, (q + 2 * r) % 12) for q in (0, 4, 5, 50) for r in range(6)], "qid int, rank int, id int")
    classes = metrics.Classes(asked, items)
    rows = lambda df: sorted(tuple(x if x is None else round(x, 9) for x in r) for r in df.collect())
    assert rows(metrics.per_query(asked, ranking, classes, 3)) == rows(metrics.per_query(asked, ranking, pairs, 3))
    assert rows(metrics.retrieval(asked, ranking, classes)) == rows(metrics.retrieval(asked, ranking, pairs))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["The cat sat on the mat. A mat of a cat! Why not?", "dogs and cats and mats " * 40, "", None, "mat " * 9 + "cat.", "Python programs run. " * 60]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "doc_id int, text string")


def test_texts_are_cut_where_they_are(spark, texts):
    got = chunking.recursive(texts, size=60, overlap=7)
    assert "Exchange" not in planned(got)
    want = chunking.with_overlap(texts.select("doc_id", F.posexplode(chunking._udf(lambda t: chunking.split_recursively(t, 60), "parts")("text")).alias("chunk_index", "text")), overlap=7)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100


def test_token_vectors_do_not_travel(spark, texts):
    got = embed.token_vectors(texts, "doc_id", dimension=4, most=5)
    assert "Exchange" not in planned(got)
    rows = {(r.doc_id, r.pos): r.vec for r in got.collect()}
    assert rows[0, 1] == rows[6, 1] and rows[1, 1] == pytest.approx(rows[1, 3]) and rows[2, 0] == rows[3, 0]  # the cat, and, no word
    assert {p for d, p in rows if d == 1} == set(range(5)) and all(sum(x * x for x in v) == pytest.approx(1) for v in rows.values())
    lengths = spark.createDataFrame([([3.0, 4.0],), ([],), (None,), ([1.0],)], "v array<double>").select(vx.squared_length(F.col("v"))).collect()
    assert [r[0] for r in lengths] == [25.0, 0.0, None, 1.0]


def test_words_are_searched_in_place_as_by_postings(spark, texts):
    index = sparse.build(texts)
    asked = spark.createDataFrame([(1, "cat mat mat"), (2, "python"), (3, "the nothing"), (4, "and dogs, cats")], "qid int, query string")
    want = sorted(map(tuple, sparse.best(sparse.scores(index, asked, b=0.3), 4).collect()))
    assert sorted(map(tuple, sparse.search(index, asked, 4, b=0.3).collect())) == want and len(want) > 8
    whole = sparse.build(texts).postings.groupBy("token").count()
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, whole.collect()))
    assert "Join" not in planned(sparse.search(index, asked, 4)) and planned(sparse.build(texts).terms).count("Exchange") == 1
    assert sparse.search(index, asked.where("qid = 3"), 4).count() == sparse.search(index, asked.where("qid > 9"), 4).count() == 0
    hits = fusion.hybrid(embed.embed(texts, embed.HashingEncoder(16)), index, embed.embed(asked, embed.HashingEncoder(16), "query"), 2)
    assert "SortMergeJoin" not in planned(hits)


def test_few_values_are_objects_at_once(spark, monkeypatch):
    sizes = []
    values = pa.array([str(i) if i % 7 else None for i in range(1000)])
    got = batches.in_slices(values, lambda part: sizes.append(len(part)) or pa.array(part, pa.string()))
    assert got.equals(values) and max(sizes) == batches.SLICE and sum(sizes) == 1000
    assert batches.in_slices(values.slice(0, 0), lambda part: pa.array(part, pa.string())).equals(values.slice(0, 0))
