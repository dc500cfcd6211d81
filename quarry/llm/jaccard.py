"""N-gram Jaccard join by grouped prefixes: exact, whatever the number of copies.

1. All shingles are counted; a table of fixed size says which of them many documents share. Sets are ordered by
   (count class, hash), rare shingles first. Any fixed order is right; this one keeps common passages out of prefixes.
2. Two sets of similarity t share a shingle among their first n - ceil(t n) + 1. Documents of identical prefix and
   size form a group, which sends its prefix once; documents with equal sets are one class and compared once.
3. Near copies of one text may be a fixed share of all documents, and meet in many lists. Around the centers of such
   clusters, majorities of sampled sets, lie cells: sets that share half of their union with the center. Pairs within a
   cell are never listed: its sets are compared block by block as bits, a bit for each member of the center, and
   the members beyond it. Which centers the sample shows decides no result: sets of no cell are paired with all others.
4. In a posting list, groups pair only with groups of fitting size, and where what follows the shingle in both sets is
   enough for the similarity; a long list is cut into blocks, and each two blocks meet in a task of their own. Group
   pairs are expanded to pairs of classes.
   Each set has a parity bitmap of about as many bits as members; the bits in which two bitmaps differ are at most
   the members in which the sets differ, so pairs with too many are dropped without error. The others are verified on
   the whole sets, in tasks of bounded pairs that receive each set once.
5. Links between classes, counts of their members and components give one row a document.

Defined results: null or empty text has an empty set and no links, its component is itself; rows that repeat a
doc_id and its text give repeated rows and count as one document; rows with a null id are nobody's links and get the
result of equal texts, or a null component; an empty table gives no rows; extra columns are ignored. Sets hold 64-bit
hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, exchange_partitions, materialize, trimmed
from .components import components
from .members import perhaps
from .packed import SCHEMA, bucket_of, dump, exchange, load, receive, send
from .textblocks import U, mix, shingle_sets, text_blocks

#: Slots of the table of common shingles: 2 ** this.
SLOT_BITS = 22
#: Pairs that one task verifies at most, on average.
PAIRS_A_TASK = 100_000
#: Pairs that a task makes out of posting lists at once.
PAIRS_AT_ONCE = 250_000
#: Pairs beyond which a posting list is cut into blocks, and entries of a block; blocks are paired in tasks of their own.
PAIRS_A_LIST, LIST_BLOCK = 2_000_000, 4096
#: Prefix entries that a map task holds before it sends them.
HELD = 500_000
#: One in so many sets is sampled for centers; a center stands for so many sampled sets at least, and for a majority of so many at most.
SAMPLED, LEAST_SAMPLE, MAJORITY_OF = 64, 3, 15
#: Members of all centers together, and centers, at most: 8 MB are broadcast.
CENTER_MEMBERS, CENTERS = 1_000_000, 8192
#: Least members of a set and of a center by which they are brought together, and the percentage of their union that they share at least.
SET_KEYS, CENTER_KEYS, IN_CELL = 6, 8, 50
#: Sets of a cell that one task compares with as many others.
CELL_BLOCK = 2000
#: Sets of two blocks beyond which a member that they share outside of the center gets a bit.
BIT_FROM = 32
#: Entries of a cell from which it is set apart in a posting list.
CELL_IN_LIST = 32


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(24) & U((1 << SLOT_BITS) - 1)).astype(np.int64)


class _Sampled:
    """Different sets of equal least member: their number, and some of them."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()
        self.sets: dict[bytes, np.ndarray] = {}

    def add(self, s: np.ndarray) -> None:
        name = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
        self.seen.add(name)
        self.sets[name] = s
        if len(self.sets) > 2 * MAJORITY_OF:
            self.sets = {k: self.sets[k] for k in sorted(self.sets)[:MAJORITY_OF]}

    def center(self) -> np.ndarray | None:
        """The members of most of them; None if these are few, or no large part of the sets."""
        some = [self.sets[k] for k in sorted(self.sets)[:MAJORITY_OF]]
        if len(some) < LEAST_SAMPLE:
            return None
        h, n = np.unique(np.concatenate(some), return_counts=True)
        h = h[2 * n > len(some)]
        return h if sum(2 * len(h) >= len(s) for s in some) >= LEAST_SAMPLE else None


class Cells:
    """Centers by number, from 1; those of the largest clusters come first, and a set is in the first cell that it fits."""

    def __init__(self, centers: list[np.ndarray]):
        self.centers = [np.zeros(0, U)]
        self.by_key: dict[int, list[int]] = {}
        for s in centers:
            if self.of(s, CENTER_KEYS, 80):  # much the same as another
                continue
            for key in s[:CENTER_KEYS].tolist():
                self.by_key.setdefault(key, []).append(len(self.centers))
            self.centers.append(s)

    def of(self, s: np.ndarray, keys: int = SET_KEYS, least: int = IN_CELL) -> int:
        """Number of the cell of a set, 0 if none."""
        near = {k for key in s[:keys].tolist() for k in self.by_key.get(key, ())} if self.by_key else ()
        for k in sorted(near):
            same = int(_within(s, self.centers[k]).sum())
            if 100 * same >= least * (len(s) + len(self.centers[k]) - same):
                return k
        return 0

    def split(self, s: np.ndarray, k: int) -> tuple[bytes, bytes]:
        """Which members of the center a set has, as bits in 64-bit words, and its other members."""
        bits = np.packbits(_within(self.centers[k], s), bitorder="little")
        return bits.tobytes().ljust(-(-len(bits) // 8) * 8, b"\0"), s[~_within(s, self.centers[k])].tobytes()


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b, both sorted, b not empty."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def shingle_classes(docs: DataFrame, width: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Count class of each slot of hashes: 0 where no common shingle falls, else half powers of two of its count; centers.

    All shingles are counted, by 40 bits of their hashes. The table has a fixed size: the least class that it keeps is
    as low as leaves three quarters of the slots empty, so that rare shingles seldom look common. Sampled sets meet by
    their least member; the sets that several share have a center.
    """
    common = 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in text_blocks(batches):
            sets = list(shingle_sets(block, width))
            some = [s for s in sets if len(s) and int(mix(s[-1:] ^ s[:1] ^ s[len(s) // 2 : len(s) // 2 + 1])[0]) % SAMPLED == 0]
            if some:
                names = bucket_of(mix(np.array([s[0] for s in some])), buckets)
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array([dump([s]) for s in some], pa.binary())], ["bucket", "blob"])
            for s in sets:
                s &= U(~0xFFFFFF & 0xFFFFFFFFFFFFFFFF)
            held += sets
            size += sum(map(len, held[-len(block.ids) :]))
            if size > 2 * HELD:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield from send(h, [n.astype(np.uint32)], buckets)
                held, size = [], 0
        if size:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield from send(h, [n.astype(np.uint32)], buckets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        sampled: dict[int, _Sampled] = {}
        for batch in batches:
            for arrays in map(load, batch.column(1).to_pylist()):
                if len(arrays) > 1:
                    got.append(arrays)
                else:
                    sampled.setdefault(int(arrays[0][0]), _Sampled()).add(arrays[0])
        for some in sampled.values():
            if (center := some.center()) is not None:
                yield pa.record_batch([pa.array([len(some.seen)], pa.int32()), pa.array([dump([center])], pa.binary())], ["bucket", "blob"])
        if got:
            got = [np.concatenate(x) for x in zip(*got)]
            order = np.argsort(got[0])
            h, n = got[0][order], got[1][order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            h, n = h[starts], np.add.reduceat(n, starts, dtype=np.int64)
            h, n = h[n >= common], n[n >= common]
            if len(h):
                blob = dump([h, np.clip(2 * np.log2(n), 1, 120).astype(np.uint8)])
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(128, np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                found += np.bincount(load(blob)[1], minlength=128)
        yield pa.record_batch([pa.array(range(128), pa.int32()), pa.array(found)], ["class", "n"])

    known = materialize(exchange(docs.mapInArrow(trimmed(count), SCHEMA), buckets).mapInArrow(trimmed(total), SCHEMA), "common")
    # rows of bucket 0 are counts, others centers with the number of their sampled sets
    largest = known.where("bucket > 0").withColumn("h", F.xxhash64("blob")).orderBy(F.desc("bucket"), "h").limit(CENTERS)
    largest = largest.withColumn("bytes", F.sum(F.octet_length("blob").cast("long")).over(W.orderBy(F.desc("bucket"), "h").rowsBetween(W.unboundedPreceding, 0)))
    centers = [load(row.blob)[0] for row in largest.where(F.col("bytes") <= 8 * CENTER_MEMBERS).select("blob").collect()]  # 8 MB at any size
    known, whole = known.where("bucket = 0"), known
    rows = known.mapInArrow(trimmed(spread), "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()  # 128 rows
    above = np.cumsum([n for _, n in sorted(((r["class"], r["n"]) for r in rows), reverse=True)])[::-1] if rows else np.zeros(128)
    least = int(np.argmax(np.append(above, 0) <= 1 << (SLOT_BITS - 2)))
    parts = 64
    each = (1 << SLOT_BITS) // parts

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        full = np.zeros(1 << SLOT_BITS, np.uint8)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                h, c = load(blob)
                np.maximum.at(full, _slot(h[c >= least]), c[c >= least])
        blobs = [zstandard.compress(full[i * each : (i + 1) * each].tobytes(), 1) for i in range(parts)]
        yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        top: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zstandard.decompress(blob), np.uint8)
                top[part] = np.maximum(top[part], x) if part in top else x
        if top:
            yield pa.record_batch([pa.array(list(top), pa.int32()), pa.array([x.tobytes() for x in top.values()], pa.binary())], ["bucket", "blob"])

    full = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in exchange(known.mapInArrow(trimmed(table), SCHEMA), parts).mapInArrow(trimmed(most), SCHEMA).collect():  # 4 MB at any size
        full[row.bucket * each : (row.bucket + 1) * each] = np.frombuffer(row.blob, np.uint8)
    discard(whole)
    return full, centers


def _need(n: np.ndarray | int, percent: int):
    """Least intersection that a set of n needs with a set of like size: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def _prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    length = n - int(_need(n, percent)) + 1
    of = classes[_slot(s)]
    if not of.any():
        return s[:length]
    return s[np.argsort(of, kind="stable")[:length]]


def _parity(s: np.ndarray) -> bytes:
    """Bit i: the parity of the number of members whose hash ends in i."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two parity bitmaps."""
    if len(a) < len(b):
        a, b = b, a
    x, wide = int.from_bytes(a, "little"), 8 * len(a)
    while wide > 8 * len(b):
        wide //= 2
        x = (x ^ x >> wide) & (1 << wide) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (c1, c2) those that their classes' sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            gap = np.array([differing(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * gap <= (100 - percent) * n))

    side = lambda k: classes.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    fits = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    both = pairs.join(side(1), "c1").join(side(2), "c2").where(fits).select("c1", "c2", "n1", "s1", "n2", "s2")
    return both.mapInArrow(trimmed(run), pairs.schema)


def _sets(docs: DataFrame, shared, percent: int, width: int, buckets: int, prefixes: bool) -> DataFrame:
    """Documents (id, n, fingerprint, group, cell, its parts in the cell, bitmap), or the packed prefixes of their groups. shared: the classes and cells."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, cells = shared.value
        known: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        names = ["id", "n", "f1", "f2", "g", "cell", "bits", "rest", "sig"]

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, *others = (np.concatenate(x) for x in zip(*held))
                yield from send(h, others, buckets)

        for block in text_blocks(batches):
            rows = np.zeros((len(block.ids), 5), np.int64)
            sigs, bits, rest = ([None] * len(block.ids) for _ in range(3))
            for i, s in enumerate(shingle_sets(block, width)):
                n = len(s)
                if not n:
                    continue
                with np.errstate(over="ignore"):
                    f1, f2 = mix(s).sum(dtype=U), mix(s * U(0x9E3779B97F4A7C15) + U(7)).sum(dtype=U)
                    prefix = _prefix(s, classes, percent)
                    cell = cells.of(s)
                    g = mix(np.array([mix(prefix + U(n)).sum(dtype=U) + U(n)]) ^ U(cell << 32))
                if not prefixes:
                    sigs[i] = _parity(s)
                    if cell:
                        bits[i], rest[i] = cells.split(s, cell)
                    rows[i] = [n, f1.view(np.int64), f2.view(np.int64), g.view(np.int64)[0], cell]
                elif int(g[0]) not in known:
                    known.add(int(g[0]))
                    held.append((prefix, np.broadcast_to(g, len(prefix)), np.broadcast_to(np.int32(n), len(prefix)), np.arange(len(prefix), dtype=np.uint32), np.broadcast_to(np.uint32(cell), len(prefix))))
                    count += len(prefix)
                    if count > HELD:
                        yield from flush()
                        held.clear()
                        count = 0
                        known.clear()
            if not prefixes:
                yield pa.record_batch([block.ids, *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)), *(pa.array(x, pa.binary()) for x in (bits, rest, sigs))], names)
        yield from flush()

    return docs.mapInArrow(trimmed(run), SCHEMA if prefixes else f"id {kind}, n bigint, f1 bigint, f2 bigint, g bigint, cell bigint, bits binary, rest binary, sig binary")


def _met(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Distinct pairs of groups that fit, of entries (group, size, place in the prefix, cell) of one list, side by side; none within a cell.

    If the shingle is the first that two sets share, no more than what follows it can be shared; a pair for which that
    is too little is found in another list or is none.
    """
    (ga, na, pa_, ca), (gb, nb, pb, cb) = left, right
    least = percent * (na + nb)
    fits = ((ca != cb) | (ca == 0)) & ((100 + percent) * (na - pa_) >= least) & ((100 + percent) * (nb - pb) >= least)
    x, y = ga[fits].view(np.int64), gb[fits].view(np.int64)
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)


def _reach(n: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """The largest size that an entry can pair with, itself the smaller; less than its own if with none."""
    return np.minimum(100 * n // percent, (100 + percent) * (n - p) // percent - n)


def _crossed(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """_met of the entries (group, size, place, cell, number) on the left, each with those of a greater number on the right."""
    (g, n, p, cell, i), (gr, nr, pr, cr, ir) = left, right
    each = max(1, PAIRS_AT_ONCE // max(1, len(gr)))
    for a in range(0, len(g), each):
        s = slice(a, a + each)
        x, y = np.nonzero((ir[None] > i[s, None]) & (nr[None] <= _reach(n[s], p[s], percent)[:, None]))
        pairs = _met([c[s][x] for c in (g, n, p, cell)], [c[y] for c in (gr, nr, pr, cr)], percent)
        if len(pairs):
            yield pairs


def _listed(sent: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(g1, g2, job): pairs of groups that share a prefix shingle and fit, or a job: two blocks of a long list to pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches)
        if not got:
            return
        h, g, n, p, cell = got
        del got
        order = np.lexsort((g, n, h))
        h, g, n, p, cell = h[order], g[order], n[order].astype(np.int64), p[order].astype(np.int64), cell[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])
        h, g, n, p, cell = h[new], g[new], n[new], p[new], cell[new]
        del order, new

        def jobs(left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(left), LIST_BLOCK):
                for j in range(0, len(right), LIST_BLOCK):
                    blob = dump([x[at] for at in (left[i : i + LIST_BLOCK], right[j : j + LIST_BLOCK]) for x in (g, n, p, cell, np.arange(len(h)))])
                    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], ["g1", "g2", "job"])

        # entries of a cell in a list meet the list's other entries, then leave it
        stays = np.ones(len(h), bool)
        edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        celled = np.add.reduceat((cell > 0).astype(np.int64), edges[:-1])
        for k in np.flatnonzero(celled >= CELL_IN_LIST).tolist():
            own = np.arange(edges[k], edges[k + 1])
            many_of = np.bincount(cell[own])
            many_of[0] = 0
            for c in np.argsort(-many_of)[: int((many_of >= CELL_IN_LIST).sum())].tolist():
                inside, own = own[cell[own] == c], own[cell[own] != c]
                stays[inside] = False
                if len(inside) * len(own) > PAIRS_A_LIST:
                    yield from jobs(inside, own)
                    yield from jobs(own, inside)
                elif len(own):
                    a, b = ([*(x[at] for x in (g, n, p, cell)), at] for at in (inside, own))
                    for one, two in ((a, b), (b, a)):
                        for pairs in _crossed(one, two, percent):
                            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.binary())], ["g1", "g2", "job"])
        h, g, n, p, cell = h[stays], g[stays], n[stays], p[stays], cell[stays]
        if not len(h):
            return
        # a list's entries ascend in size: those that entry i can pair with, as the smaller, end where sizes are too large
        edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        list_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        span = int(n.max()) + 2
        top = np.clip(_reach(n, p, percent), 0, span - 1)
        stop = np.minimum(edges[list_of + 1], np.searchsorted(list_of * span + n, list_of * span + top, side="right"))
        many = np.maximum(stop - np.arange(len(h)) - 1, 0)
        for k in np.flatnonzero(np.add.reduceat(many, edges[:-1]) > PAIRS_A_LIST).tolist():
            own = np.arange(edges[k], edges[k + 1])
            live, last = own[many[own] > 0], int(stop[own].max())
            many[own] = 0
            for i in range(0, len(live), LIST_BLOCK):
                some = live[i : i + LIST_BLOCK]
                yield from jobs(some, np.arange(int(some[0]) + 1, max(int(some[0]) + 1, min(last, int(stop[some].max())))))
        live = np.flatnonzero(many > 0)
        at = 0
        while at < len(live):
            total = np.cumsum(many[live[at : at + 50_000]])
            take = max(1, int(np.searchsorted(total, PAIRS_AT_ONCE)))
            some = live[at : at + take]
            left = np.repeat(some, many[some])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
            pairs = _met([x[left] for x in (g, n, p, cell)], [x[right] for x in (g, n, p, cell)], percent)
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.binary())], ["g1", "g2", "job"])
            at += take

    return exchange(sent, buckets).mapInArrow(trimmed(run), "g1 bigint, g2 bigint, job binary")


def _group_pairs(sent: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(g1, g2): pairs of different groups that share a prefix shingle and fit in size and place. Long lists are many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                both = load(blob)
                for pairs in _crossed(both[:5], both[5:], percent):
                    yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["g1", "g2"])

    listed = materialize(_listed(sent, percent, buckets), "lists")
    jobs = listed.where("job is not null").select("job").repartition(exchange_partitions(sent.sparkSession, 4))
    pairs = listed.where("job is null").select("g1", "g2").union(jobs.mapInArrow(trimmed(run), "g1 bigint, g2 bigint"))
    pairs = materialize(pairs.distinct(), "grouppairs")
    discard(listed)
    return pairs


def _candidate_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, s): packed shingle sets of the documents in wanted (c)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.record_batch([block.ids, pa.array([s.tobytes() for s in shingle_sets(block, width)], pa.binary())], ["c", "s"])

    kind = docs.schema["id"].dataType.simpleString()
    near = perhaps(docs.select("id", "text"), wanted.select(F.col("c").alias("id")))
    return near.join(wanted, F.col("id") == F.col("c"), "left_semi").mapInArrow(trimmed(sets), f"c {kind}, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (c1, c2), c1 < c2, whose sets are similar; sets travel once to each task that compares them."""
    kind = pairs.schema["c1"].dataType.simpleString()
    # pairs of a cluster meet under the least neighbour of their lesser class; large ones split into blocks
    both = pairs.select("c1", "c2").union(pairs.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    least = both.groupBy("c1").agg(F.least(F.min("c2"), F.first("c1")).alias("label")).withColumnRenamed("c1", "k")
    labelled = pairs.join(least, F.col("c1") == F.col("k")).drop("k")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("m")).select(F.col("label").alias("l"), F.ceil(F.sqrt(F.col("m") / PAIRS_A_TASK)).cast("int").alias("side"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("side")).cast("int")
    keyed = labelled.join(sizes, F.col("label") == F.col("l")).select("label", block(F.col("c1")).alias("x"), block(F.col("c2")).alias("y"), "c1", "c2")
    keyed = materialize(keyed, "pairs")
    key = ["label", "x", "y"]
    need = keyed.select(*key, F.col("c1").alias("c")).union(keyed.select(*key, F.col("c2").alias("c"))).distinct()
    rows = need.join(sets, "c").select(*key, F.lit(0).alias("kind"), F.col("c").alias("c1"), F.col("c").alias("c2"), "s")
    rows = rows.unionByName(keyed.select(*key, F.lit(1).alias("kind"), "c1", "c2", F.lit(None).cast("binary").alias("s")))
    rows = rows.repartition(exchange_partitions(pairs.sparkSession), *key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets_of = None, {}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            found = []
            for label, x, y, what, c1, c2, s in zip(*cols):
                if (label, x, y) != now:
                    now, sets_of = (label, x, y), {}
                if what == 0:
                    sets_of[c1] = np.frombuffer(s, U)
                    continue
                a, b = sets_of[c1], sets_of[c2]
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < percent * len(b):
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                same = int((b[at] == a).sum())
                if 100 * same >= percent * (len(a) + len(b) - same):
                    found.append((c1, c2))
            if found:
                yield pa.record_batch([pa.array([f[k] for f in found], batch.column(4).type) for k in (0, 1)], ["c1", "c2"])

    return rows.mapInArrow(trimmed(run), f"c1 {kind}, c2 {kind}")


def _compared(left: pa.Table, right: pa.Table, percent: int) -> np.ndarray:
    """Which sets on the left are similar to which on the right, all of one cell."""
    both = [pa.concat_tables([left.select([x]), right.select([x])]).column(0) for x in ("n", "bits", "rest")]
    size, k = both[0].to_numpy(), len(left)
    bits = np.frombuffer(b"".join(both[1].to_pylist()), U).reshape(len(size), -1)
    rest = [np.frombuffer(x, U) for x in both[2].to_pylist()]
    h, at = np.concatenate(rest), np.repeat(np.arange(len(size)), [len(x) for x in rest])
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(1, np.int64)
    shared = np.zeros((k, len(size) - k), np.int32)
    long = np.flatnonzero(np.diff(edges) > BIT_FROM)
    more = np.zeros((len(size), -(-len(long) // 64) * 64), np.uint8)
    for column, e in enumerate(long.tolist()):
        more[at[edges[e] : edges[e + 1]], column] = 1
    for e in np.flatnonzero((np.diff(edges) > 1) & (np.diff(edges) <= BIT_FROM)).tolist():
        own = at[edges[e] : edges[e + 1]]
        i, j = own[own < k], own[own >= k] - k
        if len(i) and len(j):
            shared[i[:, None], j[None]] += 1
    bits = np.concatenate([bits, np.packbits(more, axis=1, bitorder="little").view(U)], 1) if len(long) else bits
    links = np.zeros(shared.shape, bool)
    for a in range(0, k, 128):
        s = slice(a, min(k, a + 128))
        for w in range(bits.shape[1]):
            shared[s] += np.bitwise_count(bits[s, None, w] & bits[None, k:, w])
        links[s] = (100 + percent) * shared[s].astype(np.int64) >= percent * (size[s, None] + size[None, k:])
    return links


def _hubs(links: np.ndarray) -> np.ndarray:
    """For the sets on the left, then those on the right: the number of one set of the left that links reach, -1 if none."""
    hub = [np.full(n, -1) for n in links.shape]
    for i in range(links.shape[0]):
        if hub[0][i] < 0 and links[i].any():
            hub[0][i], new = i, np.array([i])
            while len(new):
                met = np.flatnonzero(links[new].any(0) & (hub[1] < 0))
                hub[1][met] = i
                new = np.flatnonzero(links[:, met].any(1) & (hub[0] < 0))
                hub[0][new] = i
    return np.concatenate(hub)


def _cell_links(classes: DataFrame, percent: int) -> DataFrame:
    """(c, others, hub): parts of the number of documents in the classes of c's cell that c is linked to, and an edge to a class it reaches."""
    kind = classes.schema["c"].dataType.simpleString()
    sizes = classes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("side")).withColumnRenamed("cell", "of_cell")
    placed = classes.join(F.broadcast(sizes), F.col("cell") == F.col("of_cell")).select("cell", F.pmod(F.xxhash64("c", "f1"), F.col("side")).cast("int").alias("block"), "side", "c", "members", F.col("n").cast("long").alias("n"), "bits", "rest")
    other = F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other")
    pairs = placed.select("*", other).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "*")

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, x, y = (rows.column(k).to_numpy() for k in ("block", "x", "y"))
        same = x[0] == y[0]
        left, right = rows.filter(pa.array(block == x)), rows.filter(pa.array(block == y))
        links = _compared(left, right, percent)
        if same:
            np.fill_diagonal(links, False)
        members = [t.column("members").to_numpy().astype(np.float64) for t in (left, right)]
        hub, sums = _hubs(links), [np.zeros(n) for n in links.shape]
        for a in range(0, len(links), 256):
            some = links[a : a + 256].astype(np.float64)
            sums[0][a : a + 256] = some @ members[1]
            sums[1] += members[0][a : a + 256] @ some
        c = pa.concat_tables([left.select(["c"]), right.select(["c"])]).column(0)
        reached = c.take(pa.array(np.where(hub < 0, 0, hub), mask=hub < 0))
        keep = len(left) if same else len(c)
        others = np.concatenate(sums)[:keep]
        yield from pa.table({"c": c[:keep], "others": pa.array(others.astype(np.int64)), "hub": reached[:keep]}).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]).tolist() if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and tuple(keys[a]) != now:
                    yield from compared(pa.Table.from_batches(held))
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from compared(pa.Table.from_batches(held))

    key = ["cell", "x", "y"]
    rows = pairs.select(*key, "block", "c", "members", "n", "bits", "rest").repartition(exchange_partitions(classes.sparkSession), *key).sortWithinPartitions(*key)
    return rows.mapInArrow(trimmed(run), f"c {kind}, others bigint, hub {kind}")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 70, width: int = 3) -> DataFrame:
    """(id_col, n_shingles, n_similar, component_id) of every row."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    buckets = exchange_partitions(spark, 2)
    counts, centers = shingle_classes(docs, width, buckets)
    shared = spark.sparkContext.broadcast((counts, Cells(centers)))
    found = materialize(_sets(docs, shared, percent, width, buckets, False), "sets")
    rows = found.select("id", "n", "f1", "f2")
    filled = found.where("n > 0")
    # a class: documents of equal sets, named by the least id
    classes = filled.groupBy("f1", "f2").agg(F.countDistinct("id").alias("members"), F.min("id").alias("c"), F.min("n").alias("n"), F.min("g").alias("g"), F.min("cell").alias("cell"), F.first("bits").alias("bits"), F.first("rest").alias("rest"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    pairs = _group_pairs(_sets(docs, shared, percent, width, buckets, True), percent, buckets)
    left = classes.select(F.col("c").alias("c1"), F.col("g").alias("g1"))
    right = classes.select(F.col("c").alias("c2"), F.col("g").alias("g2"))
    across = pairs.join(left, "g1").join(right, "g2").select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"))
    several = classes.where("cell = 0").groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
    inner = classes.join(several, "g", "left_semi")
    within = inner.select(F.col("c").alias("c1"), "g").join(inner.select(F.col("c").alias("c2"), "g"), "g").where("c1 < c2").select("c1", "c2")
    expanded = materialize(_may_link(across.union(within), classes, percent), "expanded")
    wanted = materialize(expanded.select(F.col("c1").alias("c")).union(expanded.select(F.col("c2").alias("c"))).distinct(), "wanted")
    sets = materialize(_candidate_sets(docs, wanted, width), "candidates")
    links = materialize(_verified(expanded, sets, percent), "links")
    for table in (sets, wanted, expanded, pairs):
        discard(table)
    inside = materialize(_cell_links(classes.where("cell > 0 and c is not null"), percent), "cells")
    stars = inside.where("hub is not null").select(F.col("c").alias("a"), F.col("hub").alias("b"))
    of = components(links.select(F.col("c1").alias("a"), F.col("c2").alias("b")).union(stars))
    members = classes.select("c", "members")
    both = links.select("c1", "c2").union(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    linked = both.join(members, F.col("c2") == F.col("c")).select(F.col("c1").alias("k"), F.col("members").alias("others"))
    linked = linked.union(inside.select("c", "others")).groupBy("k").agg(F.sum("others").alias("others"))
    classed = classes.join(linked, F.col("c") == F.col("k"), "left").join(of.withColumnsRenamed({"id": "i"}), F.col("c") == F.col("i"), "left")
    classed = materialize(
        classed.select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.greatest(F.col("members") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "c").alias("component_id")),
        "classed",
    )
    out = rows.join(classed, (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.coalesce("component_id", "id").alias("component_id"))
