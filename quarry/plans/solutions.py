"""Ready-made facades: question answering over documents, a knowledge base that grows, a research assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import cite, sparse
from quarry.plans import rag
from quarry.sources import indexes, loaders


class _Indexed:
    """Chunks of all documents that were added, kept as one table."""

    def __init__(self, spark: SparkSession, settings: rag.Settings | None = None):
        self.spark, self.settings = spark, settings or rag.Settings()
        self.chunks: DataFrame | None = None

    def add_documents(self, paths: list[str]) -> None:
        docs = loaders.load(self.spark, paths)
        self.add_texts(docs.select(F.col("path").alias("doc_id"), "text"))

    def add_texts(self, docs: DataFrame) -> None:
        """docs: (doc_id, text)."""
        more = rag.chunked(docs.withColumn("doc_id", F.col("doc_id").cast("string")), self.settings)
        self.chunks, self.added = more if self.chunks is None else self.chunks.unionByName(more), more

    def _known(self) -> DataFrame:
        if self.chunks is None:
            raise RuntimeError("add documents first")
        return self.chunks

    def questions(self, questions: str | list[str]) -> DataFrame:
        rows = [questions] if isinstance(questions, str) else questions
        return self.spark.createDataFrame(list(enumerate(rows)), "qid int, question string")

    def save_index(self, path: str) -> None:
        indexes.save(self._known(), path, "cosine", self.settings.encoder.dimension)

    def load_index(self, path: str) -> None:
        self.chunks = indexes.load(self.spark, path)[0]


class DocumentQA(_Indexed):
    def ask_detailed(self, questions: str | list[str]) -> DataFrame:
        return rag.basic(self._known(), self.questions(questions), self.settings)

    def ask(self, question: str) -> str:
        return self.ask_detailed(question).first()["answer"]


class KnowledgeBase(_Indexed):
    """Hybrid search over what was added so far; each addition is cut, encoded and indexed once."""

    def __init__(self, spark: SparkSession, settings: rag.Settings | None = None, alpha: float = 0.5):
        super().__init__(spark, settings)
        self.alpha = alpha
        self.words: sparse.SparseIndex | None = None

    def add_texts(self, docs: DataFrame) -> None:
        before = self.chunks
        super().add_texts(docs)
        more = self.added
        self.words = sparse.build(more, "chunk_id") if before is None else sparse.add(self.index(), more, "chunk_id")

    def search(self, questions: str | list[str]) -> DataFrame:
        return rag.hybrid_hits(self._known(), self.questions(questions), self.settings, self.alpha, index=self.index())

    def ask(self, questions: str | list[str]) -> DataFrame:
        return rag.answer(self.questions(questions), self.search(questions), self.settings)

    def size(self) -> int:
        return 0 if self.chunks is None else self.chunks.count()

    def index(self) -> sparse.SparseIndex:
        self._known()
        return self.words

    def save(self, path: str) -> None:
        """Chunks, words and the state of the base, all that load needs."""
        self.save_index(f"{path}/chunks")
        sparse.write(self.index(), f"{path}/words")
        state = [(self.chunks.select("doc_id").distinct().count(), self.size(), self.alpha)]
        self.spark.createDataFrame(state, "doc_count bigint, chunk_count bigint, alpha double").coalesce(1).write.mode("overwrite").json(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: rag.Settings | None = None) -> KnowledgeBase:
        """FileNotFoundError where nothing was saved."""
        base = cls(spark, settings)
        base.load_index(f"{path}/chunks")
        base.words = sparse.read(spark, f"{path}/words")
        base.alpha = spark.read.json(f"{path}/state").first()["alpha"]
        return base


class ResearchAssistant(_Indexed):
    def research(self, questions: str | list[str]) -> DataFrame:
        """Answers from several steps with their citations."""
        rows = rag.agentic(self._known(), self.questions(questions), self.settings)
        return rows.join(cite.report(rows), "qid")

    def ask(self, question: str) -> str:
        return self.research(question).first()["answer"]
