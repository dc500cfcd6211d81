"""Repeated byte strings by prefix-free parsing: bytes that a string of LENGTH bytes covers which an earlier document has.

A rolling hash runs over windows of TRIGGER bytes; a window is a trigger if its hash is the least within some LENGTH
bytes, so every string of LENGTH bytes holds one and equal strings hold equal ones. Triggers cut a text into phrases,
and a phrase is extended to all strings of LENGTH bytes around its trigger, so that none crosses a phrase's end and
the order of the parse beyond it is never needed. The dictionary is the set of distinct phrases, the parse the list of
phrases by document and position.

1. The parse is partitioned by trigger as packed arrays; a task sends each phrase once, with its least document.
   Triggers of one document fall away. A phrase that an earlier document has is repeated as a whole.
2. Left are the first occurrences of phrases whose trigger has several phrases. Their bytes are fetched, the suffixes
   of these dictionary phrases are sorted, and in this order strings of equal first LENGTH bytes meet: all but those of
   the least document are repeated.
3. Positions from both steps meet their texts, partitioned by document.

Phrases are told apart by 48-bit hashes within a trigger, strings in step 2 by their bytes.

Defined results: ids are integers, null ones come after all others; null or empty text has no bytes; rows that repeat
an id are no earlier documents for each other; matches never cross texts; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exchange_partitions, materialize, trimmed
from .members import perhaps
from .packed import bucket_of, dump, exchange, load
from .textblocks import U, Block, mix, prefix_hashes, text_blocks

LENGTH = 50
TRIGGER = 20
#: Parse entries that a map task holds before it sends them.
HELD = 400_000
#: Dictionary phrases whose suffixes are sorted at once.
SORTED_AT_ONCE = 8_000
#: Repeated positions that a task holds before it sends them by part, and bytes of the rows that it yields at once.
FOUND_HELD, AT_ONCE = 400_000, 1 << 20
LAST = np.iinfo(np.int64).max

BEFORE = LENGTH - TRIGGER
_wide = BEFORE + LENGTH
#: A string of LENGTH bytes reaches so far to one side of its trigger at least.
HALF = BEFORE // 2


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every width neighbours."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Parse:
    """Triggers of a block of texts: key, phrase hash, text, position in it."""

    def __init__(self, block: Block):
        n = len(block.raw)
        self.total, self.inverse = prefix_hashes(block.raw)
        self.ends = block.ends
        none = np.zeros(0, np.int64)
        self.text, self.position, self.key = none, none, np.zeros(0, U)
        if n < LENGTH:
            return
        x = mix((self.total[TRIGGER:] - self.total[:-TRIGGER]) * self.inverse[: n - TRIGGER + 1]) | U(1)
        width = LENGTH - TRIGGER + 1
        least = _slide(x, width, np.minimum)
        for end in block.ends[1:-1].tolist():  # strings that would cross into the next text
            least[max(0, end - LENGTH + 1) : end] = 0
        edge = np.zeros(width - 1, U)
        at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum)[: len(x)] == x)
        self.text = np.searchsorted(block.ends, at, "right") - 1
        self.position, self.key = at - block.ends[self.text], x[at]

    def phrases(self, text: np.ndarray, position: np.ndarray) -> np.ndarray:
        """48-bit hashes of the phrases there."""
        at = self.ends[text] + position
        start, end = np.maximum(at - BEFORE, self.ends[text]), np.minimum(at + LENGTH, self.ends[text + 1])
        body = (self.total[end] - self.total[start]) * self.inverse[start]
        return mix(body + (at - start).astype(U) * U(0x9E3779B97F4A7C15) + (end - at).astype(U)) >> U(16)


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _part(document: np.ndarray, parts: int) -> np.ndarray:
    return ((document ^ document >> 17) % parts).astype(np.int32)


def _part_column(document: Column, parts: int) -> Column:
    return F.pmod(document.bitwiseXOR(F.shiftright(document, 17)), F.lit(parts)).cast("int")


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return max(n, 2)


FOUND = ["kind", "part", "blob"]
FOUND_TYPES = "kind int, part int, blob binary"


def _together(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a blob, in batches of bounded size: a batch costs more than a row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > AT_ONCE:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _by_part(kind: int, parts: int, document: np.ndarray, *others: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, blob) of entries sorted by document, a row for each part of the documents."""
    yield from _together(_part_rows(kind, parts, document, *others), [pa.int32(), pa.int32(), pa.binary()], FOUND)


def _part_rows(kind: int, parts: int, document: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    of = _part(document, parts)
    order = np.lexsort((others[0], document, of))
    of, document, others = of[order], document[order], [o[order] for o in others]
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield kind, int(of[a]), dump([(document[a:b].view(U) ^ U(1 << 63)), *(o[a:b] for o in others)])


def _entries(blobs: list[bytes]) -> list[np.ndarray]:
    """document, position, left, right, phrase, all sorted by document."""
    if not blobs:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)]
    cols = [np.concatenate(c) for c in zip(*map(load, blobs))]
    cols[0] = (cols[0] ^ U(1 << 63)).view(np.int64)
    order = np.argsort(cols[0], kind="stable")
    return [c[order] if k in (0, 4) else c[order].astype(np.int64) for k, c in enumerate(cols)]


def _parsed(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Packed parse by bucket of the trigger, and positions that are repeated within what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        repeated: list[list[np.ndarray]] = []
        count, sent = 0, 0

        def settle(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal sent
            if sum(len(r[0]) for r in repeated) > most:
                document, position, phrase = (np.concatenate(c) for c in zip(*repeated))
                repeated.clear()
                for found in _by_part(0, parts, document, *_whole(position, phrase)):
                    names = pa.array([(sent := sent + 1) % buckets for _ in range(len(found))], pa.int32())
                    yield pa.record_batch([names, *found.columns], ["bucket", *FOUND])

        def flush() -> Iterator[pa.RecordBatch]:
            key, phrase, document, position = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((document, phrase, key))
            key, phrase, document, position = key[order], phrase[order], document[order], position[order]
            new = _first_of_runs(key, phrase)
            least = document[new][np.cumsum(new) - 1]
            again = document > least
            repeated.append([document[again], position[again], phrase[again]])
            yield from settle(FOUND_HELD)
            key, phrase, document, position = (c[~again] for c in (key, phrase, document, position))
            edges = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            slices = ((b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist())
            rows = ((b, None, None, dump([key[s], phrase[s], document[s], position[s].astype(np.uint32)])) for b, s in slices)
            yield from _together(rows, [pa.int32(), pa.int32(), pa.int32(), pa.binary()], ["bucket", *FOUND])

        for block in text_blocks(batches):
            parse = Parse(block)
            if not len(parse.key):
                continue
            documents = block.ids.to_numpy(zero_copy_only=False)
            held.append([parse.key, parse.phrases(parse.text, parse.position), documents[parse.text], parse.position])
            count += len(parse.key)
            if count > HELD:
                yield from flush()
                held.clear()
                count = 0
        if count:
            yield from flush()
        yield from settle(0)

    return docs.mapInArrow(trimmed(run), f"bucket int, {FOUND_TYPES}")


def _whole(position: np.ndarray, phrase: np.ndarray) -> list[np.ndarray]:
    n = len(position)
    return [position.astype(np.uint32), np.full(n, BEFORE, np.uint8), np.full(n, LENGTH, np.uint8), phrase]


def _matched(parsed: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Kind 0: repeated positions; kind 1: first occurrences whose bytes step 2 needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = []
        for batch in batches:
            ready = batch.column(1).is_valid()
            if ready.true_count:
                yield pa.record_batch(batch.columns[1:], FOUND).filter(ready)
            cols += [load(blob) for blob in batch.column(3).filter(pc.invert(ready)).to_pylist()]
        if not cols:
            return
        key, document = np.concatenate([c[0] for c in cols]), np.concatenate([c[2] for c in cols])
        order = np.argsort(key, kind="stable")
        key, document = key[order], document[order]
        new = _first_of_runs(key)
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        several = (np.minimum.reduceat(document, starts) != np.maximum.reduceat(document, starts))[group]
        order, key, document = order[several], key[several], document[several]
        phrase, position = np.concatenate([c[1] for c in cols])[order], np.concatenate([c[3] for c in cols])[order]
        cols.clear()
        if not len(key):
            return
        order = np.lexsort((document, phrase, key))
        key, phrase, document, position = key[order], phrase[order], document[order], position[order]
        new_key, new = _first_of_runs(key), _first_of_runs(key, phrase)
        least = document[new][np.cumsum(new) - 1]
        again = document > least
        phrases = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        yield from _by_part(0, parts, document[again], *_whole(position[again], phrase[again]))
        need = ~again & (phrases > 1)
        n = int(need.sum())
        yield from _by_part(1, parts, document[need], position[need], np.zeros(n, np.uint8), np.zeros(n, np.uint8), phrase[need])

    return exchange(parsed, buckets).mapInArrow(trimmed(run), FOUND_TYPES)


def _with_entries(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """(part, kind, id, o, text, blob): the entries of a part of the documents (kind < 9), then their texts."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs = [pack((t.as_buffer() if t.is_valid else b"") or b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.record_batch([*batch.columns[:2], pa.array(blobs, pa.binary())], ["id", "o", "blob"])

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.select("id", "o", "text").mapInArrow(trimmed(squeeze), f"id {kind}, o bigint, blob binary")
    texts = texts.select(_part_column(F.col("o"), parts).alias("part"), F.lit(9).alias("kind"), "id", "o", "blob")
    rows = texts.unionByName(found.select("part", "kind", "blob"), allowMissingColumns=True)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")


def _texts(batches: Iterator[pa.RecordBatch], held: dict[int, list[bytes]]) -> Iterator[tuple[pa.Scalar, int, bytes]]:
    """(id, o, bytes) of the texts of _with_entries; held gets the entries by kind before."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k, (kind, o, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if kind == 9:
                yield batch.column(2)[k], o, unpack(blob)
            else:
                held.setdefault(kind, []).append(blob)


def _of(entries: list[np.ndarray], o: int, parse: Parse | None) -> list[np.ndarray]:
    """Entries of a document; if ids repeat (parse given), those whose phrase this text has there."""
    a, b = np.searchsorted(entries[0], [o, o], "left")[0], np.searchsorted(entries[0], o, "right")
    some = [e[a:b] for e in entries]
    if parse is not None and b > a:
        n = int(parse.ends[-1])
        fine = some[1] < n
        some = [e[fine] for e in some]
        same = parse.phrases(np.zeros(len(some[1]), np.int64), some[1]) == some[4]
        some = [e[same] for e in some]
    return some


def _block_of(raw: bytes) -> Block:
    return Block(pa.array([0]), np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))


def _result(raw: bytes, some: list[np.ndarray]) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and the bytes kept."""
    n = len(raw)
    if not len(some[0]):
        return n, 0, 0, raw
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(some[1] - some[2], 0), 1)
    np.add.at(change, np.minimum(some[1] + some[3], n), -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


ROW = ["id", "o", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _row_types(kind: str) -> str:
    return f"id {kind}, o bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _fetched(rows: DataFrame, kind: str, buckets: int, repeats: bool) -> DataFrame:
    """Results of step 1 by document, and the phrases that step 2 needs, packed by bucket of the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        whole = wanted = None
        keys: list[np.ndarray] = []
        parts: list[list[np.ndarray]] = []
        out: list[tuple] = []
        type_: pa.DataType = pa.int64()
        count = 0

        def ready() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array([hash(r[1]) % buckets for r in out], pa.int32()), pa.nulls(len(out), pa.binary()), *(pa.array([r[k] for r in out], type_ if k == 0 else pa.string() if k == 5 else pa.int64()) for k in range(6))], ["bucket", "blob", *ROW])
                out.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys)
            cols = [np.concatenate(c) for c in zip(*parts)]
            order = np.argsort(key, kind="stable")
            key, cols = key[order], [c[order] for c in cols]
            edges = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            slices = ((b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist())
            rows = ((b, dump([key[s], *(c[s] if c.ndim == 1 else c[s].reshape(-1) for c in cols)])) for b, s in slices)
            for sent in _together(rows, [pa.int32(), pa.binary()], ["bucket", "blob"]):
                n = len(sent)
                yield pa.record_batch([*sent.columns, pa.nulls(n, type_), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.string())], ["bucket", "blob", *ROW])

        for id_, o, raw in _texts(batches, held):
            if whole is None:
                whole, wanted, type_ = _entries(held.pop(0, [])), _entries(held.pop(1, [])), id_.type
            block = _block_of(raw)
            parse = Parse(block) if repeats and len(raw) else None
            n, removed, spans, kept = _result(raw, _of(whole, o, parse))
            out.append((id_.as_py(), o, n, removed, spans, hashlib.sha256(kept).hexdigest()))
            if len(out) >= 2000:
                yield from ready()
            _, need, _, _, phrases = _of(wanted, o, parse)
            if len(need):
                padded = np.concatenate([np.zeros(BEFORE, np.uint8), block.raw, np.zeros(LENGTH, np.uint8)])
                phrase = np.lib.stride_tricks.sliding_window_view(padded, _wide)[need]
                total, inverse = prefix_hashes(block.raw)
                trigger = mix((total[need + TRIGGER] - total[need]) * inverse[need])
                left, right = np.minimum(need, BEFORE), np.minimum(n - need, LENGTH)
                for side, fits in ((0, left >= HALF), (1, right >= LENGTH - HALF)):
                    keys.append(_side_key(trigger[fits], phrase[fits], side))
                    parts.append([np.full(int(fits.sum()), o, np.int64), need[fits].astype(np.uint32), left[fits].astype(np.uint8), right[fits].astype(np.uint8), phrases[fits] if repeats else phrases[fits] * U(0), phrase[fits]])
                    count += int(fits.sum())
                if count > HELD // 4:
                    yield from flush()
                    keys.clear()
                    parts.clear()
                    count = 0
        yield from ready()
        if count:
            yield from flush()

    return rows.mapInArrow(trimmed(run), f"bucket int, blob binary, {_row_types(kind)}")


def _words(m: np.ndarray) -> np.ndarray:
    """Rows of bytes as 64-bit numbers of the same order."""
    return np.ascontiguousarray(np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))).view(">u8").astype(U)


def _side_key(trigger: np.ndarray, phrase: np.ndarray, side: int) -> np.ndarray:
    """Of the trigger with the HALF bytes before it (side 0) or after it (1): a shared string holds one of the two.

    So a trigger with very many phrases is many groups, of which only those with shared strings are large.
    """
    h = trigger
    for w in _words(phrase[:, BEFORE - HALF : BEFORE] if side == 0 else phrase[:, BEFORE + TRIGGER : BEFORE + TRIGGER + HALF]).T:
        h = mix(h * U(0x9E3779B97F4A7C15) + w)
    return h & ~U(1) | U(side)


def _suffix_matches(key: np.ndarray, document: np.ndarray, left: np.ndarray, right: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, left, right): how far the repeated strings around the triggers of these phrases reach."""
    order = np.lexsort((document, key))
    new = _first_of_runs(key[order])
    group, starts, d = np.cumsum(new) - 1, np.flatnonzero(new), document[order]
    may = np.zeros(len(key), bool)
    may[order] = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[group]
    rows = np.flatnonzero(may)
    side = key[rows] & U(1)
    # suffixes of the dictionary phrases, LENGTH bytes and more, in order of their first LENGTH bytes
    grams, owner, reach = [], [], []
    for a in range(BEFORE + 1):
        some = rows[(side == U(a < HALF)) & (left[rows] >= a) & (right[rows] >= LENGTH - a)]
        grams.append(_words(phrase[some, BEFORE - a : BEFORE - a + LENGTH]))
        owner.append(some)
        reach.append(np.full(len(some), a))
    grams, owner, reach = np.concatenate(grams), np.concatenate(owner), np.concatenate(reach)
    order = np.lexsort((document[owner], *grams.T[::-1]))
    grams, owner, reach = grams[order], owner[order], reach[order]
    new = _first_of_runs(*grams.T)
    again = document[owner] > document[owner][new][np.cumsum(new) - 1] if len(owner) else np.zeros(0, bool)
    owner, reach = owner[again], reach[again]
    order = np.argsort(owner, kind="stable")
    owner, reach = owner[order], reach[order]
    starts = np.flatnonzero(_first_of_runs(owner))
    if not len(starts):
        return owner, reach, reach
    return owner[starts], np.maximum.reduceat(reach, starts), LENGTH - np.minimum.reduceat(reach, starts)


def _sorted_out(fetched: DataFrame, kind: str, buckets: int, parts: int) -> DataFrame:
    """Results of step 1 as they came, and positions that step 2 finds repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = []
        type_: pa.DataType = pa.int64()
        for batch in batches:
            type_ = batch.column(2).type
            plain = batch.column(1).is_null()
            if plain.true_count:
                some = batch.filter(plain)
                yield pa.record_batch([*(pa.nulls(some.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())), *some.columns[2:]], [*FOUND, *ROW])
            for blob in batch.column(1).drop_null().to_pylist():
                c = load(blob)
                c[6] = c[6].reshape(-1, _wide)
                cols.append(c)
        if not cols:
            return
        key, document, position, left, right, hashed, phrase = (np.concatenate(c) for c in zip(*cols))
        cols.clear()
        order = np.argsort(key, kind="stable")
        borders = np.append(np.flatnonzero(_first_of_runs(key[order])), len(key))
        at, held, count = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for found in _by_part(2, parts, *(np.concatenate(c) for c in zip(*held))):
                n = len(found)
                yield pa.record_batch([*found.columns, pa.nulls(n, type_), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.string())], [*FOUND, *ROW])

        while at < len(key):
            end = int(borders[max(np.searchsorted(borders, at + SORTED_AT_ONCE, "right") - 1, np.searchsorted(borders, at, "right"))])
            s = order[at:end]
            rows, l, r = _suffix_matches(key[s], document[s], left[s], right[s], phrase[s])
            s = s[rows]
            if len(s):
                held.append([document[s], position[s], l.astype(np.uint8), r.astype(np.uint8), hashed[s]])
                count += len(s)
            at = end
            if count > FOUND_HELD:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return exchange(fetched, buckets).mapInArrow(trimmed(run), f"{FOUND_TYPES}, {_row_types(kind)}")


def _applied(rows: DataFrame, fields: str, repeats: bool, every: bool, keep: bool) -> DataFrame:
    """Results from all entries: of every document, or of those with entries of step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        entries = late = None
        for id_, o, raw in _texts(batches, held):
            if entries is None:
                late = np.unique(_entries(held.get(2, []))[0])
                entries = _entries([b for k in (0, 2) for b in held.pop(k, [])])
            at = np.searchsorted(late, o)
            if not every and (at == len(late) or late[at] != o):
                continue
            parse = Parse(_block_of(raw)) if repeats and len(raw) else None
            n, removed, spans, kept = _result(raw, _of(entries, o, parse))
            cols = [pa.array([id_.as_py()], id_.type), *(pa.array([v]) for v in (o, n, removed, spans, hashlib.sha256(kept).hexdigest()))]
            yield pa.record_batch([*cols, *([pa.array([kept], pa.binary())] if keep else [])], [*ROW, *(["kept"] if keep else [])])

    return rows.mapInArrow(trimmed(run), fields)


def _late_documents(late: DataFrame) -> DataFrame:
    """(o) of the documents with entries of step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.unique(load(blob)[0]) for blob in batch.column(0).to_pylist()]
            if some:
                yield pa.record_batch([pa.array((np.unique(np.concatenate(some)) ^ U(1 << 63)).view(np.int64))], ["o"])

    return late.select("blob").mapInArrow(trimmed(run), "o bigint").distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every row; keep adds kept, the bytes that stay."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer, not {kind}")
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[id_col].cast("long"), F.lit(LAST)).alias("o"), df[text_col].cast("string").alias("text"))
    buckets, parts = exchange_partitions(spark, 2), _prime(exchange_partitions(spark))
    repeats = not docs.groupBy("o").count().where("count > 1").isEmpty()
    found = materialize(_matched(_parsed(docs.select("o", "text"), buckets, parts), buckets, parts), "phrases")
    fetched = _fetched(_with_entries(docs, found, parts), kind, buckets, repeats)
    second = materialize(_sorted_out(fetched, kind, buckets, parts), "suffixes")
    late = second.where("part is not null").select(*FOUND)
    entries = found.where("kind = 0").unionByName(late)
    names = [F.col("id").alias(id_col), *ROW[2:]]
    if keep:
        return _applied(_with_entries(docs, entries, parts), f"{_row_types(kind)}, kept binary", repeats, True, True).select(*names, "kept")
    early = second.where("part is null").select(*ROW)
    changed = materialize(_late_documents(late), "late")
    again = _applied(_with_entries(perhaps(docs, changed.select(F.col("o").alias("id")), "o"), entries, parts), _row_types(kind), repeats, False, False)
    return early.join(changed, "o", "left_anti").select(*ROW).unionByName(again).select(*names)
