"""Encoders: text columns to vectors. Models are pluggable; the defaults need none and always agree with themselves."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.batches import in_slices
from quarry.functions.text import blank_tokens
from quarry.functions.vectors import dot, norm

_word = re.compile(r"\w+")
#: Words whose place or vector a Python worker remembers.
WORDS = 100_000


class Encoder(Protocol):
    """dimension, and a column of vectors of a column of texts."""

    dimension: int

    def encode(self, text: Column) -> Column: ...


class HashingEncoder:
    """Counts of words by hash modulo dimension, as a unit vector; a text without words has the zero vector."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def encode(self, text: Column) -> Column:
        size = self.dimension

        spot: dict[str, int] = {}

        def place(word: str) -> int:
            if len(spot) >= WORDS:
                spot.clear()
            return spot.setdefault(word, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size)

        def vectors(texts: list) -> pa.Array:
            known = spot.get
            counts = np.zeros((len(texts), size))
            for row, t in zip(counts, texts):
                found = [x if (x := known(w)) is not None else place(w) for w in _word.findall((t or "").lower())]
                row += np.bincount(np.array(found, np.int64), minlength=size)
            counts /= np.maximum(np.sqrt(np.square(counts).sum(1)), 1e-12)[:, None]
            return pa.ListArray.from_arrays(np.arange(0, counts.size + 1, size, dtype=np.int32), pa.array(counts.reshape(-1)))

        def run(texts: pa.Array) -> pa.Array:
            return in_slices(texts, vectors)

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<double>")(text)


class ModelEncoder:
    """Any function from a list of texts to a matrix, loaded once in each Python worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, normalize: bool = True):
        self.load, self.dimension, self.normalize = load, dimension, normalize

    def encode(self, text: Column) -> Column:
        from collections.abc import Iterator

        load, size, normalize = self.load, self.dimension, self.normalize

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for texts in batches:
                out = np.asarray(model([t or "" for t in texts.to_pylist()]), float).reshape(len(texts), size)
                if normalize:
                    out = out / np.maximum(np.sqrt(np.square(out).sum(1)), 1e-12)[:, None]
                yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), pa.array(out.reshape(-1)))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<double>")(text)


def _library(name: str, use: str):
    from importlib import import_module

    try:
        return import_module(name)
    except ImportError as missing:
        raise ImportError(f"{use} needs the package {name}: install it on every executor") from missing


def sentence_model(name: str, dimension: int, device: str = "cpu") -> ModelEncoder:
    """Vectors of a sentence-transformers model."""

    def load() -> Callable[[list[str]], np.ndarray]:
        model = _library("sentence_transformers", "sentence_model").SentenceTransformer(name, device=device)
        return lambda texts: model.encode(texts, show_progress_bar=False)

    return ModelEncoder(load, dimension)


#: Components of the hosted models' vectors.
HOSTED = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


def hosted(name: str = "text-embedding-3-small", batch: int = 100, dimension: int | None = None, connect: Callable[[], object] | None = None) -> ModelEncoder:
    """Vectors of a hosted model, with a key from the executors' environment. connect: another client of the same form."""

    def load() -> Callable[[list[str]], np.ndarray]:
        client = connect() if connect else _library("openai", "hosted").OpenAI()

        def encode(texts: list[str]) -> np.ndarray:
            plain = [t.replace("\n", " ") or " " for t in texts]
            parts = [client.embeddings.create(input=plain[i : i + batch], model=name).data for i in range(0, len(plain), batch)]
            return np.array([d.embedding for part in parts for d in part])

        return encode

    return ModelEncoder(load, dimension or HOSTED[name])


def clip_texts(name: str = "openai/clip-vit-base-patch32", dimension: int = 512) -> ModelEncoder:
    """The text tower of a two-tower model of texts and images."""

    def load() -> Callable[[list[str]], np.ndarray]:
        lib, torch = _library("transformers", "clip_texts"), _library("torch", "clip_texts")
        model, prepare = lib.CLIPModel.from_pretrained(name).eval(), lib.CLIPProcessor.from_pretrained(name)

        def encode(texts: list[str]) -> np.ndarray:
            with torch.no_grad():
                return model.get_text_features(**prepare(text=texts, return_tensors="pt", padding=True, truncation=True)).numpy()

        return encode

    return ModelEncoder(load, dimension)


def clip_images(name: str = "openai/clip-vit-base-patch32", dimension: int = 512) -> ModelEncoder:
    """The image tower, over a column of paths that executors can read; its vectors share the space of clip_texts."""

    def load() -> Callable[[list[str]], np.ndarray]:
        lib, torch = _library("transformers", "clip_images"), _library("torch", "clip_images")
        pictures = _library("PIL.Image", "clip_images")
        model, prepare = lib.CLIPModel.from_pretrained(name).eval(), lib.CLIPProcessor.from_pretrained(name)

        def encode(paths: list[str]) -> np.ndarray:
            with torch.no_grad():
                return model.get_image_features(**prepare(images=[pictures.open(p).convert("RGB") for p in paths], return_tensors="pt")).numpy()

        return encode

    return ModelEncoder(load, dimension)


class Fallback:
    """An encoder whose model may be missing: its vectors, or those of another encoder of like dimension where it fails to load."""

    def __init__(self, first: ModelEncoder, second: ModelEncoder):
        if first.dimension != second.dimension:
            raise ValueError("both encoders must have one dimension")
        self.dimension = first.dimension

        def load() -> Callable[[list[str]], np.ndarray]:
            try:
                return first.load()
            except Exception:  # whatever a model's loader raises
                return second.load()

        self.own = ModelEncoder(load, self.dimension)

    def encode(self, text: Column) -> Column:
        return self.own.encode(text)


def embed(df: DataFrame, encoder: Encoder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    return df.withColumn(out_col, encoder.encode(F.col(text_col)))


def token_vectors(df: DataFrame, id_col: str = "id", text_col: str = "text", dimension: int = 128, most: int = 512) -> DataFrame:
    """(id, pos, vec): a seeded unit vector for each of the first most words, which depends on the word alone.

    Vectors are made where the texts are: neither words nor vectors travel.
    """
    words = F.slice(blank_tokens(F.coalesce(F.col(text_col), F.lit(""))), 1, most)
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("[empty]")))
    seen: dict[str, np.ndarray] = {}
    state = np.random.RandomState()  # seeded anew for each word: making one takes ten times as long

    def vector(word: str) -> np.ndarray:
        v = seen.get(word)
        if v is None:
            if len(seen) >= WORDS // 2:
                seen.clear()
            state.seed(int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big"))
            v = state.randn(dimension)
            v = seen[word] = v / max(float(v.dot(v)) ** 0.5, 1e-12)
        return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, given = batch.column(0), batch.column(1)
            for i in range(0, len(ids), 16):  # 16 texts have at most 16 * most vectors
                part = given.slice(i, 16)
                flat, n = part.flatten().to_pylist(), part.value_lengths().to_numpy()
                row = np.repeat(np.arange(i, i + len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                m = np.concatenate([vector(w) for w in flat])
                yield pa.record_batch([ids.take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, m.size + 1, dimension, dtype=np.int32), pa.array(m))], [id_col, "pos", "vec"])

    rows = df.select(id_col, words.alias("words"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pos int, vec array<double>")


def token_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], id_col: str = "id", text_col: str = "text", most: int = 512) -> DataFrame:
    """(id, pos, vec): unit vectors of a text's first most tokens by any model, a matrix a text, loaded once in each Python worker."""
    from collections.abc import Iterator

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            rows = []
            for m in model([t or "" for t in texts.to_pylist()]):
                m = np.asarray(m, float)[:most]
                rows.append((m / np.maximum(np.sqrt(np.square(m).sum(1)), 1e-12)[:, None]).tolist())
            yield pa.array(rows, pa.list_(pa.list_(pa.float64())))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.select(id_col, F.posexplode(F.arrow_udf(run, "array<array<double>>")(text_col)).alias("pos", "vec"))


def transformer_tokens(name: str, dimension: int = 128, device: str = "cpu") -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """A loader for token_model: a transformer's last states of real tokens, cut to dimension components."""

    def load() -> Callable[[list[str]], list[np.ndarray]]:
        lib, torch = _library("transformers", "transformer_tokens"), _library("torch", "transformer_tokens")
        cut, model = lib.AutoTokenizer.from_pretrained(name), lib.AutoModel.from_pretrained(name).eval().to(device)

        def encode(texts: list[str]) -> list[np.ndarray]:
            given = cut(texts, return_tensors="pt", padding=True, truncation=True).to(device)
            with torch.no_grad():
                states = model(**given).last_hidden_state[:, :, :dimension].cpu().numpy()
            return [s[m.astype(bool)] for s, m in zip(states, given["attention_mask"].cpu().numpy())]

        return encode

    return load


def similarity(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Cosine of two vectors, lengths of floor at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))
