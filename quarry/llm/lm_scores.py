"""Stupid-backoff language-model scores of documents under n-gram counts of all other documents.

Texts are cut into blocks of documents: their words as numbers in the block's own vocabulary. For the n-grams of each
order a block sends its distinct hashes with their counts, partitioned by hash; the count table of a partition sums
them over all blocks and answers each block with the totals, which join the block's exploded n-grams. Scores are summed
per document. Rows are packed arrays, so a hot n-gram is one entry a block, and each block is joined in one task of
bounded size. The count table of words also numbers them, and pairs of numbers stand for bigrams. A longer n-gram only
travels where its two shorter ones were seen in another document, as it can have no count otherwise.

The count of an n-gram for a document is its count in the table less that in the document itself: no text is scored
under its own words. With c these counts and N the words of other documents, a word w after the words h scores
c(hw) / c(h) if c(hw) > 0, else BACKOFF times its score after h without its first word; alone it scores c(w) / N, or
1 / (2 N + 2) if no other document has it. A document's score is the sum of natural logarithms over all its words.

Defined results: null or empty text has no words and score 0; rows that repeat an id are documents of their own; an
empty table gives no rows; extra columns are ignored. Words and n-grams of order 3 and more are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, exchange_partitions, materialize, release_shuffles, trimmed
from .packed import bucket_of, dump, exchange, load
from .textblocks import U, mix, text_blocks, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block, unless a single text is longer.
BLOCK_BYTES = 6 << 20


def _spread(key: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers below 2 ** bits to the highest bits of 64, which spreads neighbours."""
    odd = U(0x9E3779B97F4A7C15 >> (64 - bits) | 1)
    low = key * odd & U((1 << bits) - 1)
    low ^= low >> U(bits // 2)
    return (low * odd & U((1 << bits) - 1)) << U(64 - bits)


def _narrow(totals: np.ndarray) -> np.ndarray:
    """Totals as 32-bit numbers, or as 64-bit ones where the largest needs them."""
    return totals.astype(np.uint32 if totals.max(initial=0) < 2**32 else U)


class Words:
    """A block: its vocabulary, number of each word, end of each document among them.

    The vocabulary has hashes first; once the count table of words has answered, it has the words' corpus-wide numbers,
    all below 2 ** bits. Pairs of numbers take less room than hashes and can't be mistaken for each other.
    """

    def __init__(self, vocabulary: np.ndarray, ends: np.ndarray, numbers: np.ndarray, totals: list[np.ndarray], bits: int = 0):
        self.vocabulary, self.ends, self.numbers, self.totals, self.bits = vocabulary, ends, numbers.astype(np.int64), totals, bits
        self.sizes = np.diff(ends)
        self.document = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.numbers)) - np.repeat(ends[:-1], self.sizes)
        # by order: sorted distinct hashes, the index of each n-gram among them; an n-gram is at its last word
        self.grams = [(vocabulary, self.numbers)]
        self.hashes = vocabulary[self.numbers]

    def packed(self) -> bytes:
        # frequent words get small numbers, which take less room
        often = np.argsort(-np.bincount(self.numbers, minlength=len(self.vocabulary)), kind="stable")
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        return dump([self.vocabulary, self.ends, often.astype(np.uint32), rank[self.numbers], *(_narrow(t) for t in self.totals)])

    @classmethod
    def unpacked(cls, blob: bytes) -> Words:
        vocabulary, ends, often, ranks, *totals = load(blob)
        return cls(vocabulary, ends.astype(np.int64), often[ranks], [t.astype(np.int64) for t in totals])

    def at(self, order: int) -> np.ndarray:
        """Positions of the words that end an n-gram of this order."""
        return np.flatnonzero(self.place >= order - 1)

    def grow(self, order: int, keep: np.ndarray | None = None) -> None:
        """Find the n-grams of this order, at all positions or those in keep."""
        at = self.at(order) if keep is None else keep
        rolled = np.zeros(len(self.hashes), U)
        rolled[1:] = self.hashes[:-1]
        word = self.vocabulary[self.numbers]
        if order == 2 and 0 < self.bits <= 32:
            self.hashes = _spread(rolled << U(self.bits) | word, 2 * self.bits)
        else:
            self.hashes = mix(rolled * U(0x9E3779B97F4A7C15) + word) + U(order)
        known, index = np.unique(self.hashes[at], return_inverse=True)
        full = np.full(len(self.hashes), -1, np.int64)
        full[at] = index
        self.grams.append((known, full))

    def counts(self, order: int) -> np.ndarray:
        known, index = self.grams[order - 1]
        return np.bincount(index[index >= 0], minlength=len(known)).astype(np.uint32)

    def others(self, order: int) -> np.ndarray:
        """By position: how often other documents hold the n-gram that ends there."""
        known, index = self.grams[order - 1]
        at = np.flatnonzero(index >= 0)
        key = index[at] * len(self.sizes) + self.document[at]
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        out = np.zeros(len(index), np.int64)
        out[at] = (self.totals[order - 1] + self.counts(order))[index[at]] - own[inverse]
        return out

    def worth(self, order: int, others: np.ndarray) -> np.ndarray:
        """Positions whose n-gram of this order may be in another document; others: of the order below."""
        at = self.at(order)
        return at[(others[at] > 0) & (others[at - 1] > 0)]


def _word_scores(words: Words, others: list[np.ndarray], all_words: int) -> np.ndarray:
    """Score of each word. others: by order."""
    rest = np.maximum(all_words - words.sizes[words.document], 0).astype(float)
    score = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), -np.log(2 * rest + 2))
    for n in range(2, len(others) + 1):
        at = words.at(n)
        many, prefix = others[n - 1][at], others[n - 2][at - 1]
        seen = many > 0
        score[at] = np.where(seen, np.log(np.maximum(many, 1)) - np.log(np.maximum(prefix, 1)), score[at] + np.log(BACKOFF))
    return score


def _parse(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in text_blocks(batches, BLOCK_BYTES):
            hashes, ends = word_hashes(block, lower=False)
            vocabulary, numbers = np.unique(hashes, return_inverse=True)
            blob = Words(vocabulary, ends.astype(np.int64), numbers, []).packed()
            ids = pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids)
            yield pa.record_batch([pa.array([number]), ids, pa.array([len(hashes)], pa.int64()), pa.array([blob], pa.binary())], ["block", "ids", "n", "blob"])
            number += 1

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(run), f"block bigint, ids array<{kind}>, n bigint, blob binary")


def _opened(blob: bytes, orders: int, bits: int = 0) -> tuple[Words, list[np.ndarray]]:
    """A block with its n-grams of up to this order found, and the counts of others where totals are known."""
    words, others = Words.unpacked(blob), []
    words.bits = bits
    for n in range(1, orders + 1):
        if n > 1:
            words.grow(n, words.worth(n, others[-1]) if n > 2 else None)
        if n <= len(words.totals):
            others.append(words.others(n))
    return words, others


def _send(blocks: DataFrame, orders: list[int], buckets: int, bits: int = 0) -> DataFrame:
    """(bucket, block, blob): distinct hashes and counts of the block's n-grams in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, _ = _opened(blob, orders[-1], bits)
                known = [words.grams[n - 1][0] for n in orders]
                counts = [words.counts(n) for n in orders]
                edges = [np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1)) for h in known]
                used = [b for b in range(buckets) if any(e[b + 1] > e[b] for e in edges)]
                blobs = [dump([*(h[e[b] : e[b + 1]] for h, e in zip(known, edges)), *(c[e[b] : e[b + 1]] for c, e in zip(counts, edges))]) for b in used]
                if used:
                    yield pa.record_batch([pa.array(used, pa.int32()), pa.array([block] * len(used)), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    return blocks.select("block", "blob").mapInArrow(trimmed(run), "bucket int, block bigint, blob binary")


def _answer(sent: DataFrame, buckets: int, number: bool = False) -> DataFrame:
    """(block, bucket, blob): totals over all other blocks, in the order sent; with number, also a number of each n-gram.

    Numbers differ between n-grams and are as small as buckets of like size allow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bucket, parts = [], None, []
        for batch in batches:
            names += batch.column(1).to_pylist()
            parts += [load(blob) for blob in batch.column(2).to_pylist()]
            bucket = batch.column(0)[0].as_py() if batch.num_rows else bucket
        if not parts:
            return
        half = len(parts[0]) // 2
        totals = []
        for k in range(half):
            _, inverse = np.unique(np.concatenate([p[k] for p in parts]), return_inverse=True)
            own = np.concatenate([p[half + k] for p in parts])
            sums = np.bincount(inverse, weights=own) if len(inverse) else np.zeros(0)
            cuts = np.cumsum([len(p[k]) for p in parts])[:-1]
            totals.append([_narrow(t) for t in np.split(sums[inverse] - own, cuts)])
            if number:
                totals.append(np.split(inverse.astype(U) * U(buckets) + U(bucket), cuts))
        for i, name in enumerate(names):
            yield pa.record_batch([pa.array([name]), pa.array([bucket], pa.int32()), pa.array([dump([t[i] for t in totals])], pa.binary())], ["block", "bucket", "blob"])

    return exchange(sent, buckets).mapInArrow(trimmed(run), "block bigint, bucket int, blob binary")


def _joined(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(block, ids, bucket, blob): every block, then its answers by bucket, in one task."""
    rows = blocks.select("block", "ids", F.lit(-1).alias("bucket"), "blob")
    rows = rows.unionByName(answers, allowMissingColumns=True)
    return rows.repartition(exchange_partitions(blocks.sparkSession), "block").sortWithinPartitions("block", "bucket")


def _with_totals(batches: Iterator[pa.RecordBatch], orders: int) -> Iterator[tuple[int, pa.Scalar, bytes, list[np.ndarray]]]:
    """Each block of _joined with the totals of its answers."""
    now, parts = None, []
    for batch in batches:
        for i, (block, bucket) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            blob = batch.column(3)[i].as_py()
            if bucket < 0:
                if now is not None:
                    yield *now, [np.concatenate(p) for p in zip(*parts)]
                now, parts = (block, batch.column(1)[i], blob), [[np.zeros(0, np.uint32)] * orders]
            else:
                parts.append(load(blob))
    if now is not None:
        yield *now, [np.concatenate(p) for p in zip(*parts)]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id_col, n_words, score, mean_score) of every row; mean_score is null without words."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    buckets = exchange_partitions(spark)
    blocks = materialize(_parse(docs), "words")
    all_words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def keep(new: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, ids, blob, totals in _with_totals(batches, new):
                words = Words.unpacked(blob)
                words.totals += totals
                yield pa.record_batch([pa.array([block]), pa.array([ids.as_py()], ids.type), pa.array([words.packed()], pa.binary())], ["block", "ids", "blob"])

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, blob, totals in _with_totals(batches, 1):
            words = Words.unpacked(blob)
            words.totals += [t.astype(np.int64) for t in totals]
            words, others = _opened(words.packed(), order, bits)
            scores = _word_scores(words, others, all_words)
            sums = np.array([scores[a:b].sum() for a, b in zip(words.ends[:-1].tolist(), words.ends[1:].tolist())])
            yield pa.record_batch([ids.values, pa.array(words.sizes), pa.array(sums, pa.float64())], ["id", "n_words", "score"])

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, blob, (totals, numbers) in _with_totals(batches, 2):
            words = Words.unpacked(blob)
            words.totals.append(totals)
            words.vocabulary = numbers.astype(U)
            top = int(numbers.max()) if len(numbers) else 0
            yield pa.record_batch([pa.array([block]), pa.array([ids.as_py()], ids.type), pa.array([top]), pa.array([words.packed()], pa.binary())], ["block", "ids", "top", "blob"])

    numbered = materialize(_joined(blocks, _answer(_send(blocks, [1], buckets), buckets, True)).mapInArrow(trimmed(renumber), f"block bigint, ids array<{kind}>, top bigint, blob binary"), "words")
    discard(blocks)
    release_shuffles(spark)
    # the width of a number is that of the largest of the corpus
    bits = int(numbered.agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]).bit_length() or 1
    blocks, orders = numbered, [2]
    while True:
        joined = _joined(blocks, _answer(_send(blocks, orders, buckets, bits), buckets))
        if orders[-1] == order:
            found = joined.mapInArrow(trimmed(finish), f"id {kind}, n_words bigint, score double")
            mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
            return found.select(F.col("id").alias(id_col), "n_words", "score", mean.alias("mean_score"))
        new = materialize(joined.mapInArrow(trimmed(keep(len(orders))), f"block bigint, ids array<{kind}>, blob binary"), "words")
        discard(blocks)
        del joined
        release_shuffles(spark)
        blocks, orders = new, [orders[-1] + 1]
