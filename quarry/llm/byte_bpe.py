"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at live position i; every inner node holds the
least (rank, position) below it, so the root names the leftmost pair of least rank. A merge kills one leaf and
refreshes the two pairs next to it: three leaf-to-root walks of logarithmic length. Pieces are independent, so
short ones of like size are merged side by side as rows of one numpy tree; long ones use the same tree as a list.

Defined results: null text counts as empty (no ids, empty bytes); repeated rows give repeated results; extra
columns are ignored; special tokens are never recognised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

#: Rank of "no pair".
NONE = 1 << 40
#: Pieces of more bytes than this get a tree of their own.
LONG = 128
#: Distinct pieces remembered by a Python worker.
REMEMBERED = 400_000


class Vocabulary:
    """Ranks of a .tiktoken file with the pairs that merge into each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.memory: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """One segment tree, as a list."""
        n = len(piece)
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(0, n - 1).bit_length()
        pairs = self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE * width] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        dead = [False] * n

        def put(i: int, rank: int | None) -> None:
            k = width + i
            tree[k] = NONE * width if rank is None else rank * width + i
            k >>= 1
            while k:
                least = tree[2 * k] if tree[2 * k] <= tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] < NONE * width:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], dead[j] = rank, True
            k = after[i] = after[j]
            put(j, None)
            if k < n:
                before[k] = i
                put(i, pairs.get(rank << 20 | ids[k]))
            else:
                put(i, None)
            if (p := before[i]) >= 0:
                put(p, pairs.get(ids[p] << 20 | rank))
        return [x for x, gone in zip(ids, dead) if not gone]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Segment trees of pieces of 2 to width bytes, one a row; ids as little-endian 32-bit integers."""
        count = len(pieces)
        size = np.array([len(p) for p in pieces])
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        live = np.arange(width)[None] < size[:, None]
        ids = np.where(live, self.of_byte[grid], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (count, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (count, width)).copy()
        tree = np.full((count, 2 * width), NONE * width, np.int64)
        rank = self.rank_of(ids[:, :-1], np.maximum(ids[:, 1:], 0))
        rank[~live[:, 1:]] = NONE
        tree[:, width : 2 * width - 1] = rank * width + np.arange(width - 1)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(count)
        while True:
            rows = rows[tree[rows, 1] < NONE * width]
            if not len(rows):
                break
            new, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], live[rows, j] = new, False
            after[rows, i] = k
            has_k = k < size[rows]
            before[rows[has_k], k[has_k]] = i[has_k]
            p = before[rows, i]
            has_p = p >= 0
            right = np.where(has_k, self.rank_of(new, ids[rows, np.minimum(k, width - 1)]), NONE)
            left = np.where(has_p, self.rank_of(ids[rows, np.maximum(p, 0)], new), NONE)
            tree[rows, width + j] = NONE * width
            tree[rows, width + i] = right * width + i
            tree[rows[has_p], width + p[has_p]] = left[has_p] * width + p[has_p]
            changed = np.concatenate([rows, rows, rows[has_p]])
            node = np.concatenate([j, i, p[has_p]]) + width
            while node[0] > 1:
                node = node >> 1
                tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
        packed = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_pieces(self, pieces: set[str]) -> None:
        """Remember the packed ids of every piece."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.memory[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.memory[piece] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, some in by_width.items():
            for at in range(0, len(some), 1 << 15):
                part = some[at : at + (1 << 15)]
                self.memory.update(zip((p for p, _ in part), self.merge_many([raw for _, raw in part], width)))

    def encode(self, texts: list[str], split) -> list[bytes]:
        """Packed ids of each text; split: the compiled pattern's findall."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        out = []
        for text in texts:
            pieces = split(text)
            if new := set(pieces).difference(self.memory):
                self.encode_pieces(new)
            out.append(b"".join(map(self.memory.__getitem__, pieces)))
        return out

    def encode_block(self, texts: list[str], split) -> list[bytes]:
        """As encode, with all new pieces of the block merged side by side."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        pieces = [split(t) for t in texts]
        if new := set().union(*pieces).difference(self.memory):
            self.encode_pieces(new)
        return [b"".join(map(self.memory.__getitem__, p)) for p in pieces]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def _blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many characters together, or a single text."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if len(texts) > start:
        yield start, len(texts)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id_col, ids): token ids of every whole text, as array<int> or, packed, as little-endian 32-bit integers.

    Args:
        path: a .tiktoken rank file that every executor can read.
        pattern: splits a text into the pieces that are merged separately.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words, split = vocabulary(path), regex.compile(pattern).findall
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts, 1 << 20):
                found = words.encode_block(texts[a:b], split)
                if packed:
                    ids = pa.array(found, pa.binary())
                else:
                    ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), ids], ["id", "ids"])

    some = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    return some.mapInArrow(trimmed(run), f"id {kind}, ids {'binary' if packed else 'array<int>'}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """(id_col, ids, decoded binary) from ids as array<int> or packed; null ids decode to no bytes."""
    is_packed = df.schema[ids_col].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            given = batch.column(1).to_pylist()
            packed = [x or b"" for x in given] if is_packed else [np.array(x or [], "<u4").tobytes() for x in given]
            out = pa.array([words.decode(x) for x in packed], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), out], ["id", "ids", "decoded"])

    some = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    kinds = [f.dataType.simpleString() for f in some.schema.fields]
    return some.mapInArrow(trimmed(run), f"id {kinds[0]}, ids {kinds[1]}, decoded binary").withColumnRenamed("id", id_col)
