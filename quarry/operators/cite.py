"""Citations like [1] or [1, 3] in answers (qid, answer, contexts)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import blank_set, overlap, ratio

MARK = r"\[(\d+(?:\s*,\s*\d+)*)\]"
BEFORE, AFTER, SHOWN = 100, 50, 200


def cited(answer: Column, contexts: Column) -> Column:
    """Sorted distinct numbers that the answer cites and that are in range."""
    groups = F.regexp_extract_all(answer, F.lit(MARK), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("bigint"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(contexts)))))


def report(answers: DataFrame) -> DataFrame:
    """(qid, cited, uncited, attribution, highlighted): attribution is the cited part of the contexts."""
    known = answers.withColumn("cited", cited(F.col("answer"), F.col("contexts")))
    every = F.when(F.size("contexts") > 0, F.sequence(F.lit(1).cast("bigint"), F.size("contexts").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return known.select("qid", "cited", F.array_except(every, F.col("cited")).alias("uncited"), ratio(F.size("cited"), F.size("contexts")).alias("attribution"), highlight(F.col("answer")).alias("highlighted"))


def highlight(answer: Column) -> Column:
    return F.regexp_replace(answer, MARK, r"**$0**")


def spans(answers: DataFrame) -> DataFrame:
    """(qid, pos, citation_id, text_span, source_text, confidence) of every citation in range.

    The span reaches BEFORE characters back from the mark's start and AFTER on; confidence is the part of its distinct
    words that the cited context has.
    """
    kind = answers.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        mark = re.compile(MARK)
        for batch in batches:
            out: list[tuple] = []
            for row, (answer, contexts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                pos = 0
                for m in mark.finditer(answer or ""):
                    for n in map(int, m.group(1).split(",")):
                        if 1 <= n <= len(contexts or []):
                            out.append((row, pos, n, answer[max(0, m.start() - BEFORE) : m.end() + AFTER].strip(), contexts[n - 1]))
                            pos += 1
            rows = [list(c) for c in zip(*out)] if out else [[], [], [], [], []]
            yield pa.record_batch([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], ["qid", "pos", "citation_id", "text_span", "source"])

    found = answers.select("qid", "answer", "contexts").mapInArrow(run, f"qid {kind}, pos int, citation_id bigint, text_span string, source string")
    return found.select("qid", "pos", "citation_id", "text_span", F.left("source", F.lit(SHOWN)).alias("source_text"), confidence(F.col("text_span"), F.col("source")).alias("confidence"))


def confidence(span: Column, source: Column) -> Column:
    return ratio(overlap(blank_set(span), blank_set(source)), F.size(blank_set(span)))


def validate(answers: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(qid, total, valid, fidelity) of the citations; fidelity is 1 without any."""
    counts = spans(answers).groupBy("qid").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") >= threshold).alias("valid"))
    every = answers.select("qid").distinct().join(counts, "qid", "left").fillna(0, ["total", "valid"])
    return every.select("qid", "total", "valid", F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(1.0).alias("fidelity"))
