"""Question answering over chunks, for a table of questions at once: basic, agentic, corrective, graph, multimodal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import chunking, cite, dense, embed, fusion, generate, graph, prompt, queries, rerank, sparse
from quarry.operators.topk import with_texts
from quarry.scratch import kept

Generator = Callable[[Column, Column], Column]


@dataclass
class Settings:
    """Parameters that the plans share."""

    k: int = 5
    chunk_size: int = 512
    chunk_overlap: int = 64
    strategy: str = "recursive"
    template: str = "default"
    encoder: embed.Encoder = field(default_factory=embed.HashingEncoder)
    scorer: Callable[[Column, Column], Column] | None = None
    generator: Generator = generate.extractive


def chunked(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, embedding): chunk_id is doc_id and index, so it never moves."""
    chunks = chunking.preprocess(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), settings.strategy, size=settings.chunk_size, overlap=settings.chunk_overlap)
    named = chunks.select(F.format_string("%s:%06d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text")
    # every plan reads chunks several times: they are cut and encoded once
    return kept(embed.embed(named, settings.encoder), "chunks")


def _embedded(questions: DataFrame, settings: Settings, text: str = "question") -> DataFrame:
    return questions.withColumn("embedding", settings.encoder.encode(F.col(text)))


def dense_hits(chunks: DataFrame, questions: DataFrame, k: int, settings: Settings, text: str = "question") -> DataFrame:
    """(qid, rank, id, score, text)."""
    hits = dense.search(chunks, _embedded(questions, settings, text), k, id_col="chunk_id")
    return with_texts(hits, chunks.select(F.col("chunk_id").alias("id"), "text"), k * questions.count())


def answer(questions: DataFrame, hits: DataFrame, settings: Settings, first: int | None = None, keep_all: bool = True) -> DataFrame:
    """(qid, question, answer, contexts, sources, scores, prompt) from hits (qid, rank, id, score, text).

    The generator sees the first contexts; a question without hits gets a fixed answer.
    """
    parts = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "text"))).alias("h"))
    rows = questions.join(parts, "qid", "left").withColumn("h", F.coalesce("h", F.array().cast(parts.schema["h"].dataType)))
    shown = F.slice("h", 1, first) if first else F.col("h")
    texts = lambda h: F.transform(h, lambda x: x["text"])
    rows = rows.withColumns({"contexts": texts(F.col("h")), "sources": F.transform("h", lambda x: x["id"]), "scores": F.transform("h", lambda x: x["score"]), "_seen": texts(shown)})
    made = F.when(F.size("_seen") > 0, settings.generator(F.col("question"), F.col("_seen"))).otherwise(generate.NOTHING_FOUND)
    asked = prompt.render(F.col("question"), F.col("_seen"), settings.template)
    return rows.select("qid", "question", made.alias("answer"), "contexts", "sources", "scores", asked.alias("prompt"))


def basic(chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, citations: bool = True) -> DataFrame:
    """Nearest chunks, reranked if there is a scorer, an answer, and its citations. questions: (qid, question)."""
    s = settings or Settings()
    hits = dense_hits(chunks, questions, s.k * 3 if s.scorer else s.k, s)
    if s.scorer:
        hits = rerank.rerank(hits.join(questions.select("qid", F.col("question").alias("query")), "qid"), s.k, s.scorer)
    rows = answer(questions, hits.select("qid", "rank", "id", "score", "text"), s)
    return rows.join(cite.report(rows), "qid") if citations else rows


def agentic_hits(chunks: DataFrame, questions: DataFrame, settings: Settings, steps: int = 3, least: float = 0.3) -> DataFrame:
    """Hits of the question and its parts with a score of least, in order of step; one for each beginning of a text."""
    asked = questions.select("qid", F.posexplode(F.slice(queries.sub_questions(F.col("question")), 1, steps)).alias("step", "part"))
    asked = asked.withColumn("qid", F.struct("qid", "step"))
    # the pair of question and step is the id of the search
    named = asked.select(F.to_json("qid").alias("qid"), F.col("qid.qid").alias("own"), F.col("qid.step").alias("step"), "part")
    hits = dense_hits(chunks, named.select("qid", F.col("part").alias("question")), settings.k, settings)
    rows = hits.where(F.col("score") >= least).join(named.select("qid", "own", "step"), "qid")
    order = [F.asc("step"), F.asc("rank")]
    first = F.row_number().over(W.partitionBy("own", F.left("text", F.lit(100))).orderBy(*order))
    kept = rows.withColumn("n", first).where("n = 1")
    return kept.select(F.col("own").alias("qid"), F.row_number().over(W.partitionBy("own").orderBy(*order)).alias("rank"), "id", "score", "text", "step")


def agentic(chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, steps: int = 3, least: float = 0.3) -> DataFrame:
    s = settings or Settings()
    hits = agentic_hits(chunks, questions, s, steps, least).select("qid", "rank", "id", "score", "text")
    return answer(questions, hits, s, first=2 * s.k)


def corrective_hits(chunks: DataFrame, questions: DataFrame, settings: Settings, least: float = 0.35, turns: int = 2, enough: int = 2) -> DataFrame:
    """Hits near enough to the question itself; questions with too few search on with refined forms.

    All turns are searched as one table; a turn counts only for questions that are short of hits after the turns before.
    """
    forms = questions.select("qid", "question", F.explode(F.sequence(F.lit(0), F.lit(turns))).alias("turn"))
    forms = forms.withColumn("form", F.when(F.col("turn") == 0, F.col("question")).otherwise(queries.refine(F.col("question"), F.col("turn"))))
    named = forms.select(F.to_json(F.struct("qid", "turn")).alias("qid"), F.col("qid").alias("own"), "turn", "question", "form")
    hits = dense_hits(chunks, named.select("qid", F.col("form").alias("question")), settings.k, settings).join(named.select("qid", "own", "turn"), "qid")
    # grades compare with the question, not with its refined form
    vectors = _embedded(questions, settings).select(F.col("qid").alias("own"), F.col("embedding").alias("q"))
    graded = hits.join(chunks.select(F.col("chunk_id").alias("id"), "embedding"), "id").join(vectors, "own")
    graded = graded.withColumn("grade", F.round(embed.similarity(F.col("q"), F.col("embedding")), 6)).where(F.col("grade") >= least)
    order = [F.asc("turn"), F.asc("rank")]
    kept = graded.withColumn("n", F.row_number().over(W.partitionBy("own", F.left("text", F.lit(100))).orderBy(*order))).where("n = 1")
    # distinct hits before a turn decide whether it takes place
    before = F.coalesce(F.count(F.lit(1)).over(W.partitionBy("own").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).where((F.col("turn") == 0) | (F.col("before") < enough))
    return kept.select(F.col("own").alias("qid"), F.row_number().over(W.partitionBy("own").orderBy(*order)).alias("rank"), "id", F.col("grade").alias("score"), "text", "turn")


def corrective(chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, **options) -> DataFrame:
    """As basic, with status success or insufficient_evidence."""
    s = settings or Settings()
    hits = corrective_hits(chunks, questions, s, **options).select("qid", "rank", "id", "score", "text")
    rows = answer(questions, hits, s, first=s.k)
    return rows.withColumn("status", F.when(F.size("contexts") > 0, "success").otherwise("insufficient_evidence"))


def graph_hits(chunks: DataFrame, questions: DataFrame, settings: Settings, depth: int = graph.DEPTH, known: graph.Graph | None = None) -> DataFrame:
    """Chunks of entities near the question's, before nearest chunks."""
    g = known or graph.build(chunks)
    walked = graph.search(g, questions, settings.k, depth, query_col="question")
    near = dense.search(chunks, _embedded(questions, settings), settings.k, "chunk_cosine", id_col="chunk_id")
    near = with_texts(near, chunks.select(F.col("chunk_id").alias("id"), "text"), settings.k * questions.count())
    return graph.merge(walked, near, settings.k)


def graph_rag(chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, depth: int = graph.DEPTH) -> DataFrame:
    s = settings or Settings()
    return answer(questions, graph_hits(chunks, questions, s, depth).select("qid", "rank", "id", "score", "text"), s)


def hybrid_hits(docs: DataFrame, questions: DataFrame, settings: Settings, alpha: float = 0.5, id_col: str = "chunk_id", index: sparse.SparseIndex | None = None) -> DataFrame:
    index = index or sparse.build(docs, id_col)
    return fusion.hybrid(docs, index, _embedded(questions, settings), settings.k, alpha, id_col=id_col, query_col="question")


def multimodal(items: DataFrame, questions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Answers over items (id, modality, text, caption, embedding) of one vector space; images are shown by caption."""
    s = settings or Settings()
    shown = F.when(F.col("modality") == "image", F.concat(F.lit("[Image] "), F.coalesce("caption", "text"))).otherwise(F.col("text"))
    asked = questions if "embedding" in questions.columns else _embedded(questions, s)
    hits = dense.search(items, asked, s.k, id_col="id")
    hits = hits.join(items.select("id", shown.alias("text")), "id").select("qid", "rank", "id", "score", "text")
    return answer(questions.select("qid", "question"), hits, s)


PLANS = {"basic": basic, "agentic": agentic, "corrective": corrective, "graph": graph_rag}


def create(name: str) -> Callable[..., DataFrame]:
    if name not in PLANS:
        raise ValueError(f"unknown plan {name!r}; one of {sorted(PLANS)}")
    return PLANS[name]


def formatted(hits: DataFrame, chars: int = 200, keep: Sequence[str] = ()) -> DataFrame:
    """(qid, columns in keep, line): a readable line for each hit."""
    return hits.select("qid", *keep, F.format_string("[%d] %.4f  %s", "rank", "score", F.left(strip(F.col("text")), F.lit(chars))).alias("line"))
