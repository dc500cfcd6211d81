"""Cleaning and chunking: rows (id, text) to rows (id, chunk_index, text)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.batches import in_slices
from quarry.functions.text import clean, sentences, strip

SIZE, OVERLAP, LEAST = 512, 64, 20
#: White space as the JVM's patterns know it.
_blanks = re.compile(r"[ \t\n\x0b\f\r]+")
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def cleaned(df: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """df with cleaned texts of at least so many characters."""
    return df.withColumn(text_col, clean(F.col(text_col))).where(F.length(text_col) >= least)


def _exploded(df: DataFrame, chunks: Column, id_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(chunks).alias("chunk_index", "text"))


def fixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size characters every size - overlap; blank ones go, and the index counts those that stay."""
    step = max(size - overlap, 1)
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.substring(F.col(text_col), i + 1, F.lit(size)))
    return _exploded(df, F.filter(windows, lambda c: strip(c) != ""), id_col)


def _udf(split, name: str):
    """An Arrow function from texts to arrays of chunks; split: text to list."""

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: pa.array([split(t) if t else [] for t in part], pa.list_(pa.string())))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    run.__name__ = name
    return F.arrow_udf(run, "array<string>")


def split_recursively(text: str, size: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Greedy packing of the parts between the first separator; a part that is too long goes on with the next one."""
    if len(text) <= size:
        return [text] if text else []
    mark, deeper = (separators[0], separators[1:]) if separators else ("", ())
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), size)]
    done, open_ = [], ""
    for part in text.split(mark):
        longer = open_ + mark + part if open_ else part
        if len(longer) <= size:
            open_ = longer
            continue
        if open_:
            done.append(open_)
        open_ = part
        if len(part) > size:
            done += split_recursively(part, size, deeper)
            open_ = ""
    return [*done, open_] if open_ else done


def recursive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Packed parts, each led by the last overlap characters of the part before it. A text is one row till it is cut: nothing travels."""

    def split(text: str) -> list[str]:
        parts = split_recursively(text, size, separators)
        return [a[-overlap:] + b for a, b in zip(["", *parts], parts)] if overlap > 0 else parts

    return _exploded(df, _udf(split, "parts")(F.col(text_col)), id_col).where(strip(F.col("text")) != "")


def with_overlap(chunks: DataFrame, id_col: str = "doc_id", overlap: int = OVERLAP) -> DataFrame:
    """Each chunk led by the end of the one before it."""
    if overlap <= 0:
        return chunks
    before = F.lag("text").over(W.partitionBy(id_col).orderBy("chunk_index"))
    return chunks.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(overlap)), F.lit("")), F.col("text")))


def pack_sentences(lengths: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [first, last] of sentences whose lengths fit size, each starting overlap sentences before the last's end."""
    ranges, start, used = [], 0, 0
    for i, n in enumerate(lengths):
        if used + n > size and i > start:
            ranges.append((start, i - 1))
            start = max(start, i - overlap) if overlap else i
            used = sum(lengths[start:i]) + max(i - start - 1, 0)
        used += n + 1
    return [*ranges, (start, len(lengths) - 1)] if lengths else []


def by_sentence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = 1) -> DataFrame:
    """Runs of whole sentences."""

    def ranges(lengths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return in_slices(lengths, lambda part: pa.array([[{"first": a, "last": b} for a, b in pack_sentences(n or [], size, overlap)] for n in part], kind))

    ranges.__annotations__ = {"lengths": pa.Array, "return": pa.Array}
    runs = F.arrow_udf(ranges, "array<struct<first:int,last:int>>")
    cut = df.select(id_col, sentences(F.col(text_col)).alias("_s"))
    cut = cut.withColumn("_r", runs(F.transform("_s", lambda s: F.length(s))))
    return _exploded(cut, F.transform("_r", lambda r: F.array_join(F.slice("_s", r["first"] + 1, r["last"] - r["first"] + 1), " ")), id_col)


# ---------------------------------------------------------------- semantic chunks


def similarities(parts: Sequence[str]) -> list[float]:
    """Cosine of each sentence but the first with the one before it.

    A sentence's vector has ln((n + 1) / (df + 1)) + 1 for each word in it; n and df are of the text's own sentences.
    """
    words = [{w for w in _blanks.split(p.lower()) if w} for p in parts]
    often = Counter(chain.from_iterable(words))
    square = {w: (math.log((len(parts) + 1) / (k + 1)) + 1) ** 2 for w, k in often.items()}
    norms = [math.sqrt(sum(square[w] for w in s)) or 1.0 for s in words]
    return [sum(square[w] for w in a & b) / (m * n) for a, b, m, n in zip(words, words[1:], norms, norms[1:])]


def group_numbers(sims: Sequence[float], percentile: float | None = 90, threshold: float = 0.5) -> list[int]:
    """The group of each sentence: a new one starts below the text's own percentile of similarity, or a threshold."""
    if not sims:
        return [0]
    limit = threshold if percentile is None else float(np.percentile(sims, 100 - percentile)) - 1e-12
    return [0, *accumulate(int(s < limit) for s in sims)]


def _with_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, sentences(F.col(text_col)).alias("_s"))


def sentence_similarity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, sim) of texts, see similarities. Each text is one row throughout: nothing travels."""

    def run(parts: pa.Array) -> pa.Array:
        return in_slices(parts, lambda some: pa.array([similarities(p) if p else [] for p in some], pa.list_(pa.float64())))

    run.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    sims = F.arrow_udf(run, "array<double>")("_s")
    return _with_sentences(df, id_col, text_col).select(id_col, F.posexplode(sims).alias("idx", "sim")).select(id_col, (F.col("idx") + 1).alias("idx"), "sim")


def semantic_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percentile: float | None = 90, threshold: float = 0.5) -> DataFrame:
    """(id, groups): an array of the texts between drops of similarity."""

    def grouped(parts: list) -> pa.Array:
        out = []
        for p in parts:
            groups: dict[int, list[str]] = {}
            for s, g in zip(p or [], group_numbers(similarities(p), percentile, threshold) if p else []):
                groups.setdefault(g, []).append(s)
            out.append([" ".join(g) for g in groups.values()])
        return pa.array(out, pa.list_(pa.string()))

    def run(parts: pa.Array) -> pa.Array:
        return in_slices(parts, grouped)

    run.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    return _with_sentences(df, id_col, text_col).select(id_col, F.arrow_udf(run, "array<string>")("_s").alias("groups"))


def settle_sizes(groups: Sequence[str], least: int, most: int) -> list[str]:
    """Short groups join their neighbours, long ones are split between sentences."""
    merged: list[str] = []
    for g in groups:
        if merged and len(merged[-1]) < least:
            merged[-1] += " " + g
        else:
            merged.append(g)
    if len(merged) > 1 and len(merged[-1]) < least:
        tail = merged.pop()
        merged[-1] += " " + tail
    out: list[str] = []
    for g in merged:
        if len(g) <= most:
            out.append(g)
            continue
        held = ""
        for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", g))):
            if held and len(held) + 1 + len(s) > most:
                out.append(held)
                held = s
            else:
                held = f"{held} {s}" if held else s
        if held:
            out.append(held)
    return out


def semantic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percentile: float | None = 90, threshold: float = 0.5, least: int = 100, most: int = 1000) -> DataFrame:
    """Groups of sentences between drops of similarity, of settled sizes."""
    folded = semantic_groups(df, id_col, text_col, percentile, threshold)

    def settle(parts: pa.Array) -> pa.Array:
        return in_slices(parts, lambda some: pa.array([settle_sizes(p or [], least, most) for p in some], pa.list_(pa.string())))

    settle.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    settled = F.arrow_udf(settle, "array<string>")("groups")
    return _exploded(folded, settled, id_col).where(strip(F.col("text")) != "")


STRATEGIES = {"recursive": recursive, "sentence": by_sentence, "fixed": fixed}


def preprocess(df: DataFrame, strategy: str = "recursive", id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Cleaned texts as chunks of at least so many characters; indexes stay as the strategy numbered them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    texts = cleaned(df, text_col, least)
    sizes = {"size": size} if strategy == "sentence" else {"size": size, "overlap": overlap}
    return STRATEGIES[strategy](texts, id_col, text_col, **sizes).where(F.length(strip(F.col("text"))) >= least)
