"""Answers: a pluggable model, and an extractive default that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import blank_set, overlap, sentences

NOTHING_FOUND = "No relevant passage was found."


def extractive(question: Column, contexts: Column) -> Column:
    """The sentence that shares most words with the question, first one at a tie, and the number of its context."""
    words = blank_set(question)
    rows = F.flatten(F.transform(contexts, lambda c, i: F.transform(sentences(c), lambda s, j: F.struct(overlap(words, blank_set(s)).alias("n"), (-i).alias("i"), (-j).alias("j"), s.alias("s")))))
    best = F.array_max(rows)
    return F.when(F.size(rows) > 0, F.concat(best["s"], F.lit(" ["), (1 - best["i"]).cast("string"), F.lit("]"))).otherwise(NOTHING_FOUND)


def model(load: Callable[[], Callable[[list[str]], list[str]]], most_words: int = 2048) -> Callable[[Column], Column]:
    """A generator of any model from prompts to answers, loaded once in each Python worker; long prompts are cut."""

    def answer(prompt: Column) -> Column:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            generate = load()
            for prompts in batches:
                cut = [" ".join(p.split(" ")[:most_words]) if p else "" for p in prompts.to_pylist()]
                yield pa.array(generate(cut), pa.string())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "string")(prompt)

    return answer
