import pytest
from pyspark.sql import functions as F

from quarry.plans import benchmark, rag, registry, solutions
from quarry.sources import indexes, loaders, records, settings
from quarry.streaming import incremental

TEXTS = [(1, "Neural networks learn layered features. They need much data to train well."), (2, "Rivers carry water to the sea. Fish live in rivers and lakes."), (3, "Bread is baked from flour, water and yeast in a hot oven.")]


@pytest.fixture(scope="module")
def chunks(spark):
    return rag.chunked(spark.createDataFrame(TEXTS, "doc_id int, text string"), rag.Settings(chunk_size=80, chunk_overlap=10)).cache()


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, question string")


@pytest.mark.parametrize("name", sorted(rag.PLANS))
def test_plans(spark, chunks, name):
    rows = {r.qid: r for r in rag.create(name)(chunks, asks(spark, "what do neural networks learn", "fish in rivers")).collect()}
    assert "Neural networks" in rows[0].answer and "Fish live" in rows[1].answer and rows[0].contexts


def test_corrective_and_agentic_edges(spark, chunks):
    rows = rag.corrective(chunks, asks(spark, "zzz qqq")).collect()
    assert rows[0].status == "insufficient_evidence" and rows[0].contexts == []
    steps = rag.agentic_hits(chunks, asks(spark, "neural networks and fish in rivers"), rag.Settings()).collect()
    assert len({r.text[:100] for r in steps}) == len(steps) and {r.step for r in steps} >= {0}
    with pytest.raises(ValueError):
        rag.create("none")


def test_multimodal(spark):
    items = spark.createDataFrame([(1, "image", "[file]", "a cat", [1.0, 0.0]), (2, "text", "dog", None, [0.0, 1.0]), (3, "image", "[file 3]", None, [0.9, 0.1])], "id int, modality string, text string, caption string, embedding array<double>")
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0])], "qid int, question string, embedding array<double>")
    assert rag.multimodal(items, asked).first()["contexts"] == ["[Image] a cat", "[Image] [file 3]", "dog"]


def test_solutions(spark, tmp_path):
    (tmp_path / "one.txt").write_text(TEXTS[0][1])
    (tmp_path / "two.txt").write_text(TEXTS[1][1])
    base = solutions.KnowledgeBase(spark)
    with pytest.raises(RuntimeError):
        base.search("x")
    base.add_documents([str(tmp_path)])
    base.add_texts(spark.createDataFrame(TEXTS[2:], "doc_id int, text string"))
    assert base.size() >= 3 and "yeast" in base.search("flour yeast oven").where("rank = 1").first()["text"]
    qa = solutions.DocumentQA(spark)
    qa.chunks = base.chunks
    assert "Neural" in qa.ask("what do neural networks learn")
    qa.save_index(str(tmp_path / "index"))
    again = solutions.DocumentQA(spark)
    again.load_index(str(tmp_path / "index"))
    assert again.ask("fish in rivers") == qa.ask("fish in rivers")
    assert "attribution" in solutions.ResearchAssistant.research.__doc__ or base.ask("rivers").count() == 1


def test_knowledge_base_persists_and_grows(spark, tmp_path):
    base = solutions.KnowledgeBase(spark, alpha=0.3)
    for row in TEXTS:
        base.add_texts(spark.createDataFrame([row], "doc_id int, text string"))
    rows = lambda b: [tuple(r) for r in b.search("flour and water").orderBy("qid", "rank").collect()]
    whole = solutions.KnowledgeBase(spark, alpha=0.3)
    whole.add_texts(spark.createDataFrame(TEXTS, "doc_id int, text string"))
    assert rows(base) == rows(whole)
    base.save(str(tmp_path / "base"))
    again = solutions.KnowledgeBase.load(spark, str(tmp_path / "base"))
    assert again.alpha == 0.3 and again.size() == base.size() and rows(again) == rows(base)
    assert spark.read.json(str(tmp_path / "base" / "state")).first()["doc_count"] == 3
    again.add_texts(spark.createDataFrame([(9, "Flour and water make a simple dough for flat bread.")], "doc_id int, text string"))
    assert "Flour and water make a simple dough for flat bread." in {r.text for r in again.search("flour and water").collect()}
    with pytest.raises(FileNotFoundError):
        solutions.KnowledgeBase.load(spark, str(tmp_path / "none"))


def test_benchmark(spark, chunks, tmp_path):
    sources = {r.doc_id: r.chunk_id for r in chunks.where("chunk_index = 0").collect()}
    items = spark.createDataFrame([("what do neural networks learn", "layered features", [sources[1]]), ("fish in rivers", None, [sources[2], "none"])], records.EVALUATION)
    found = {r.metric: r.value for r in benchmark.run(items, lambda q: rag.basic(chunks, q, citations=False), (1, 3), 1, str(tmp_path / "out")).collect()}
    assert found["recall@1"] == 0.75 and found["mrr"] == 1 and 0 < found["f1"] <= 1 and found["avg_latency"] == found["p95_latency"] > 0
    assert {r["metric"] for r in records.read(spark, str(tmp_path / "out")).collect()} == set(found)


def test_judgements_and_pairs(spark, tmp_path):
    (tmp_path / "j").write_text('{"query": "a", "relevant": ["x", "y"]}\n\n{"query": "b", "relevant": []}\n{"query": "a", "relevant": ["x"]}\n')
    asked, relevant = records.judgements(spark, str(tmp_path / "j"))
    assert sorted(r["query"] for r in asked.collect()) == ["a", "b"] and sorted(r.id for r in relevant.collect()) == ["x", "y"]
    (tmp_path / "p").write_text('{"query": "a", "positive": "b", "negative": "c"}\n{"query": "a"}\n')
    assert [tuple(r) for r in records.pairs(spark, str(tmp_path / "p")).collect()] == [("a", "b", "c")]


def test_exported_model(spark, tmp_path, chunks):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "weights").write_text("w")
    indexes.export(chunks, str(tmp_path / "x"), "cosine", 256, None, str(tmp_path / "m"))
    assert (tmp_path / "x" / "model" / "weights").read_text() == "w"
    assert spark.read.json(str(tmp_path / "x" / "manifest")).first()["parts"] == ["index", "settings", "model"]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hello &amp; world</p>")
    (tmp_path / "b.MD").write_text("intro\n# One\nbody\n## Two\nmore")
    (tmp_path / "c.csv").write_text("name,value\na,1\n,\nb,\n")
    (tmp_path / "d.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "e.log").write_text("other")
    rows = loaders.load(spark, str(tmp_path)).collect()
    assert {r.text for r in rows} == {"Hello & world", "intro\n# One\nbody\n## Two\nmore", "name: a\nvalue: 1", "name: b", "bad � byte"}
    assert {r.metadata["row"] for r in rows if "row" in r.metadata} == {"0", "2"}
    single = loaders.load(spark, [str(tmp_path / "e.log"), str(tmp_path / "missing.txt")]).collect()
    assert [r.text for r in single] == ["other"]
    parts = loaders.markdown_sections(spark.createDataFrame([("p", "intro\n# One\nbody\n## Two\nmore"), ("q", "plain")], "path string, text string")).collect()
    assert [(r.text, r.metadata.get("header"), r.metadata.get("level")) for r in parts] == [("body", "One", "1"), ("more", "Two", "2"), ("plain", None, None)]
    loaders.register(".log", loaders.read_text)
    assert loaders.load(spark, str(tmp_path)).count() == 6
    del loaders.READERS["log"]
    with pytest.raises(Exception, match="install"):
        (tmp_path / "f.pdf").write_bytes(b"x")
        loaders.load(spark, str(tmp_path / "f.pdf")).collect()


def test_records_and_indexes(spark, tmp_path, chunks):
    path, out = str(tmp_path / "q"), str(tmp_path / "a")
    records.write(asks(spark, "fish in rivers", "fish in rivers", "é").select("question"), path)
    records.predict(spark, path, out, lambda q: rag.basic(chunks, q, citations=False))
    assert {(r.question, r.num_sources > 0) for r in records.read(spark, out).collect()} == {("fish in rivers", True), ("é", True)}
    indexes.export(chunks, str(tmp_path / "x"), "cosine", 256, {"k": 5})
    rows, manifest = indexes.load(spark, str(tmp_path / "x" / "index"))
    assert rows.count() == chunks.count() and manifest == {"metric": "cosine", "dimension": 256}
    with pytest.raises(FileNotFoundError):
        indexes.load(spark, str(tmp_path / "nowhere"))
    pairs = records.as_prompts(spark.createDataFrame([("q", "c", "a")], "question string, context string, answer string")).first()
    assert pairs.prompt == "Context:\nc\n\nQuestion: q\n\nAnswer:" and pairs.completion == "a"


def test_every_line_is_predicted(spark, tmp_path, chunks):
    path, out = str(tmp_path / "q"), str(tmp_path / "a")
    records.write(asks(spark, "fish in rivers", "é", "fish in rivers").select("question"), path)
    records.predict(spark, path, out, lambda q: rag.basic(chunks, q, citations=False))
    rows = sorted((r.question, r.answer, r.num_sources) for r in records.read(spark, out).collect())
    assert [q for q, *_ in rows] == ["fish in rivers", "fish in rivers", "é"] and rows[0] == rows[1] and rows[0][2] > 0


def test_settings(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("retrieval:\n  k: 9\n  hybrid: true\nseed: 3\n")
    monkeypatch.setenv("QUARRY_CONFIG", str(tmp_path / "c.yaml"))
    config = settings.get().override({"retrieval.alpha": "0.2", "retrieval.hybrid": "no"})
    assert (config.retrieval.k, config.seed, config.retrieval.alpha, config.retrieval.hybrid) == (9, 3, 0.2, False)
    assert config.as_dict()["chunking"]["size"] == 512


def test_registry():
    r = registry.Registry("things")
    r.register()(test_registry)
    assert "test_registry" in r and r.list() == ["test_registry"]
    with pytest.raises(ValueError):
        r.register("test_registry")(1)
    with pytest.raises(KeyError):
        r.get("x")
    registry.auto_register()
    registry.auto_register()
    assert "basic" in registry.PIPELINES and "bm25" in registry.RETRIEVERS


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    for k in (1, 2):
        docs.where(f"doc_id % 2 = {k % 2}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.append_index(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    index = incremental.read_index(spark, str(tmp_path / "index"))
    assert index.stats.first()["n_docs"] == 3 and index.terms.where(F.col("token") == "water").first()["df"] == 2
