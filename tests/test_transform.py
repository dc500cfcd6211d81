import pytest
from pyspark.sql import functions as F

from quarry.operators import cite, generate, graph, metrics, prompt
from quarry.operators import queries as qt


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "q string").select(make(F.col("q")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (qt.decompose, "What is rust and how do crates work?", ["What is rust?", "how do crates work?"]),
        (qt.decompose, "ab", ["ab"]),
        (qt.step_back, "Why did prices rise in March?", "why does prices rise"),
        (qt.step_back, "hello", "What are the general principles behind hello?"),
        (qt.step_back, "can you tell me what happened in 2019", "what happened"),
        (qt.synonym, "The Best way", "The Top way"),
        (qt.synonym, "make, it", "create, it"),
        (qt.rephrase, "What is a graph?", "explain a graph?"),
        (qt.rephrase, "how do trees grow tall?", "what is the process for trees to grow tall?"),
        (qt.perspective, "what is x?", "Describe the key aspects of is x?"),
        (qt.perspective, "rivers", "What should someone know about rivers?"),
        (qt.keywords, "how does the big engine work", "big engine work"),
        (qt.classify, "Who wrote it?", "factual"),
        (qt.classify, "how to bake", "procedural"),
        (qt.classify, "please explain this", "conceptual"),
        (qt.classify, "cats vs. dogs", "comparative"),
        (qt.classify, "why now", "causal"),
        (qt.classify, "tell me", "general"),
        (qt.sub_questions, "compare cats and dogs", ["compare cats and dogs", "compare cats?", "What is cats?", "What is dogs?"]),
        (lambda q: qt.refine(q, 1), "x", "specifically about x key concepts"),
        (lambda q: qt.variants(q, 3), "What is good?", ["What is good?", "What is effective?", "explain good?"]),
    ],
)
def test_queries(spark, make, text, want):
    assert one(spark, make, text) == want


def test_router(spark):
    named = lambda n: lambda df: df.select("qid", F.lit(n).alias("by"))
    router = qt.Router({"a": named("a"), "b": named("b")}, {"causal": "b"})
    asks = spark.createDataFrame([(1, "why so"), (2, "how so")], "qid int, query string")
    assert {r.qid: r.by for r in router.search(asks).collect()} == {1: "b", 2: "a"}
    with pytest.raises(ValueError):
        qt.Router({})
    with pytest.raises(ValueError):
        router.route("causal", "c")


def test_graph(spark):
    chunks = spark.createDataFrame([(1, 'Then Albert Einstein uses NASA data. "the field" is big.'), (2, "NASA created things. Berlin is near Potsdam."), (3, None), (4, "")], "chunk_id int, text string")
    found = {(r.chunk_id, r.name): r.type for r in graph.extract(chunks).collect()}
    assert found[1, "Then Albert Einstein"] == "PROPER_NOUN" and found[1, "NASA"] == "ACRONYM" and found[1, "the field"] == "QUOTED_TERM" and found[2, "Potsdam"] == "NOUN"
    g = graph.build(chunks)
    edges = {tuple(r) for r in g.edges.collect()}
    assert ("then albert einstein", "uses", "nasa") in edges and ("potsdam", "inv_is", "berlin") in edges
    start = spark.createDataFrame([(9, "then albert einstein")], "qid int, entity string")
    assert {(r.entity, r.hops) for r in graph.reach(g, start, 1).collect()} >= {("then albert einstein", 0), ("nasa", 1)}
    asks = spark.createDataFrame([(9, "what did NASA do with things"), (10, "potsdamer cafes"), (11, "zzz")], "qid int, query string")
    assert {(r.qid, r.entity) for r in graph.seeds(g, asks).collect()} == {(9, "nasa"), (10, "potsdam")}
    hits = graph.search(g, asks, 2)
    assert {r.id for r in hits.where("qid = 9").collect()} == {1, 2}
    merged = graph.merge(hits, hits.withColumn("id", F.col("id") + 100), 5).where("qid = 9").collect()
    assert all(r.from_graph for r in merged) and len(merged) == 2
    assert graph.stats(g).first()["num_chunks"] == 4
    summary = graph.summaries(g, spark.createDataFrame([("NASA",), ("Nobody",)], "entity string")).collect()
    assert any("(inverse) uses -> " in r.summary for r in summary) and any(r.summary.startswith("No relations") for r in summary)


def test_prompts(spark):
    df = spark.createDataFrame([("why?", ["a", "b"], ["s", None])], "q string, c array<string>, s array<string>")
    said = df.select(prompt.render(F.col("q"), F.col("c"), "minimal", F.col("s")).alias("x"), prompt.messages(F.col("q"), F.col("c")).alias("m")).first()
    assert said.x == "Given this:\n[1] a (source: s)\n\n[2] b\n\nAnswer the question: why?"
    assert [m.role for m in said.m] == ["system", "user"]
    assert len(prompt.names()) >= 5
    with pytest.raises(ValueError):
        prompt.get("none")


def test_citations_and_answers(spark):
    answers = spark.createDataFrame([(1, "The cat sat [1] and more [1, 3] or [9].", ["the cat sat", "x", "dogs"]), (2, "none", ["a"]), (3, "[1]", [])], "qid int, answer string, contexts array<string>")
    report = {r.qid: r for r in cite.report(answers).collect()}
    assert report[1].cited == [1, 3] and report[1].uncited == [2] and report[1].attribution == pytest.approx(2 / 3)
    assert report[1].highlighted.startswith("The cat sat **[1]**") and report[3].attribution == 0
    assert {r.qid: r.fidelity for r in cite.validate(answers).collect()}[2] == 1.0
    assert cite.spans(answers).count() == 3
    q = spark.createDataFrame([("cat mat", ["Dogs run. A cat on a mat."]), ("x", [])], "q string, c array<string>")
    assert [r[0] for r in q.select(generate.extractive(F.col("q"), F.col("c"))).collect()] == ["A cat on a mat. [1]", generate.NOTHING_FOUND]
    model = generate.model(lambda: lambda prompts: [p.upper() for p in prompts])
    assert q.select(model(F.col("q"))).first()[0] == "CAT MAT"


def test_ranking_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    ranking = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20)], "qid int, rank int, id int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 99)], "qid int, id int")
    assert metrics.recall(queries, ranking, relevant, 2).first()[0] == pytest.approx((0.5 + 0) / 2)  # query 3 is skipped
    assert metrics.mrr(queries, ranking, relevant).first()[0] == pytest.approx(0.5 / 3)
    import math

    assert metrics.ndcg(queries, ranking, relevant, 2).first()[0] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 3)
    by_k = {r.k: r for r in metrics.retrieval(queries, ranking, relevant, (1, 2)).collect()}
    assert by_k[1].recall == 0 and by_k[2].recall == pytest.approx(0.25) and by_k[1].mrr == by_k[2].mrr


def test_answer_metrics(spark):
    rows = [("what is rust", "rust is a language", ["rust is fast", "a language"], "rust language"), ("", "", [], ""), ("q", "the of", ["x"], None)]
    df = spark.createDataFrame(rows, "question string, answer string, contexts array<string>, ground_truth string")
    c = F.col
    got = df.select(metrics.faithfulness(c("answer"), c("contexts")), metrics.relevance(c("question"), c("answer")), metrics.token_f1(c("answer"), c("ground_truth")), metrics.exact_match(F.lit(" A  b"), F.lit("a B ")), metrics.answer_faithfulness(c("answer"), c("contexts"))).collect()
    assert tuple(got[0]) == pytest.approx((1.0, 1.0, 2 * 2 / 6, 1.0, 1.0))
    assert tuple(got[1])[:3] == (0.0, 0.0, 0.0)
    every = metrics.evaluate(df).collect()
    assert every[0].context_precision == 1.0 and every[0].context_recall == 1.0 and every[1].context_recall == 0.0 and every[2].context_recall is None
    assert metrics.evaluate_all(df).count() == 1
    with pytest.raises(ValueError):
        metrics.evaluate(df, ["other"])
    assert metrics.latency(spark.createDataFrame([(float(i),) for i in range(1, 22)], "seconds double")).first()["p95_latency"] == pytest.approx(20.0)
