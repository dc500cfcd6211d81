"""URL filters: prefix rules, and a Bloom filter cascade that gives exact membership in a list without a join.

The universe is every key of the corpus. Level 1 encodes the listed keys of the universe, level 2 the unlisted ones
that level 1 lets through, level 3 the listed ones that level 2 lets through, and so on until nothing passes: then
the first level that refuses a key tells whether it is listed, with no error for any key of the universe.

Keys are split by hash into shards of some PER_SHARD listed keys, each with a cascade of its own built in one task:
listed keys and the false positives of level 1 are all that it holds. Level 1 has a false-positive rate at which
these are about as many as the listed keys, the others one half. A cascade whose bytes stay within BROADCAST_BYTES is
sent to every executor; a larger one stays in the shared folder, rows are ranged by shard (a hot key's rows by a salt)
and every task reads the shards it meets.

Defined results: a null url, or one without ://, has empty host and path; null keys are in no list; repeated rows give
repeated results; empty tables and empty lists give no rows and no blocks; extra columns stay, those of an added name
(a parameter), in any case, with _ appended to theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, exchange_partitions, materialize, trimmed

U = np.uint64
PER_SHARD = 200_000
BROADCAST_BYTES = 64 << 20
#: Levels a cascade may have; keys left then are kept as they are, to be looked up exactly.
MOST_LEVELS = 60


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (host/path prefix) that fits: its host or a subdomain, and a path that starts with its path."""
    found = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


# ---------------------------------------------------------------- the cascade


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(33))


class Level:
    """One Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, depth: int, bits: int, hashes: int, words: np.ndarray):
        self.depth, self.bits, self.hashes, self.words = depth, bits, hashes, words

    def spots(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        base = _mixed(a + U(self.depth) * b)
        step = _mixed(b + U(self.depth * 0x9E3779B97F4A7C15 % (1 << 64))) | U(1)
        for k in range(self.hashes):
            yield (base + U(k) * step) % U(self.bits)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, depth: int, rate: float) -> Level:
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(a) * hashes / math.log(2)))
        made = cls(depth, bits, hashes, np.zeros((bits + 63) // 64, U))
        for spot in made.spots(a, b):
            np.bitwise_or.at(made.words, (spot >> U(6)).astype(np.int64), U(1) << (spot & U(63)))
        return made

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for spot in self.spots(a, b):
            ok &= (self.words[(spot >> U(6)).astype(np.int64)] >> (spot & U(63)) & U(1)).astype(bool)
        return ok

    def packed(self) -> bytes:
        return np.array([self.depth, self.bits, self.hashes], "<u8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> Level:
        x = np.frombuffer(blob, "<u8")
        return cls(int(x[0]), int(x[1]), int(x[2]), x[3:])


def first_rate(listed: int, universe: int) -> float:
    """False-positive rate of level 1 that leaves about half as many other keys as there are listed ones."""
    others = max(1, universe - listed)
    return min(0.5, max(2.0**-30, math.sqrt(0.5) * max(1, listed) / others))


class Cascade:
    """The levels of a shard, and the keys (pairs of hashes) that no level parts."""

    def __init__(self, levels: list[Level], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    @classmethod
    def deeper(cls, listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> Cascade:
        """Levels from 2 on. others: unlisted keys that level 1 lets through."""
        inside, outside, levels = others, listed, []
        while len(inside[0]) and len(levels) < MOST_LEVELS:
            level = Level.of(*inside, depth=len(levels) + 2, rate=0.5)
            levels.append(level)
            ok = level.passes(*outside)
            inside, outside = (outside[0][ok], outside[1][ok]), inside
        # keys still in inside passed every level: listed ones must be known by name
        rest = inside if len(levels) % 2 == 0 else outside
        none = not len(inside[0])
        return cls(levels, np.zeros((0, 2), U) if none else np.stack(rest, 1))

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys that passed level 1 are listed."""
        answer, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for n, level in enumerate(self.levels):
            ok = level.passes(a[open_], b[open_])
            answer[open_[~ok]] = n % 2 == 0
            open_ = open_[ok]
        if len(self.rest):
            known = set(map(tuple, self.rest.tolist()))
            answer[open_] = [(int(x), int(y)) in known for x, y in zip(a[open_], b[open_])]
        else:
            answer[open_] = len(self.levels) % 2 == 0
        return answer


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")]


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("b", 20), F.lit(shards)).cast("int")


def _u(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(U)


@lru_cache(maxsize=4)
def _read_shard(folder: str, shard: int) -> list[tuple[int, bytes]]:
    """(depth, blob) of a shard's levels, from the shared folder."""
    from pyarrow import dataset, fs

    system, path = fs.FileSystem.from_uri(folder)
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table(filter=dataset.field("shard") == shard)
    return list(zip(table["depth"].to_pylist(), table["blob"].to_pylist()))


def _opened(rows: list[tuple[int, bytes]]) -> tuple[Level | None, Cascade]:
    levels = [Level.unpacked(b) for d, b in sorted(r for r in rows if r[0] > 0)]
    rest = next((np.frombuffer(b, "<u8").reshape(-1, 2) for d, b in rows if d == 0), np.zeros((0, 2), U))
    return (levels[0], Cascade(levels[1:], rest)) if levels else (None, Cascade([], rest))


class Filter:
    """An exact list over a universe of keys: rows (shard, depth, blob) in the shared folder."""

    def __init__(self, table: DataFrame, shards: int, size: int, broadcast_bytes: int):
        self.table, self.shards, self.size = table, shards, size
        spark = table.sparkSession
        self.sent = None
        if size <= broadcast_bytes:
            by_shard: dict[int, list] = {}
            for r in table.collect():  # at most broadcast_bytes
                by_shard.setdefault(r["shard"], []).append((r["depth"], bytes(r["blob"])))
            self.sent = spark.sparkContext.broadcast({k: _opened(v) for k, v in by_shard.items()})

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with a boolean column: whether the key is listed; false for null. A column that name clashes with gets _ appended."""
        shards, sent = self.shards, self.sent
        folder = None if sent is not None else self.table.inputFiles()[0].rsplit("/", 1)[0]
        salt = [F.col(f"`{c}`") for c, kind in df.dtypes if kind in ("bigint", "int", "string")]
        df, _ = aside(df, [name])
        marked = df.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(*salt, F.lit(0)).alias("salt"))
        marked = marked.select("row", "salt", "key", *_hashes(F.col("key"))).withColumn("shard", _shard(shards))
        if sent is None:
            marked = marked.repartitionByRange(exchange_partitions(df.sparkSession), "shard", "salt")

        def listed(a: pa.Array, b: pa.Array, shard: pa.Array) -> pa.Array:
            x, y, s = _u(a), _u(b), shard.to_numpy(zero_copy_only=False)
            out = np.zeros(len(x), bool)
            for k in np.unique(s).tolist():
                first, rest = sent.value.get(k, (None, None)) if sent is not None else _opened(_read_shard(folder, k))
                at = np.flatnonzero(s == k)
                if first is not None:
                    at = at[first.passes(x[at], y[at])]
                    out[at] = rest.holds(x[at], y[at])
            return pa.array(out)

        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for arrays in batches:
                yield listed(*arrays)

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        test = F.arrow_udf(run, "boolean")
        return marked.select("row.*", (F.col("key").isNotNull() & test("a", "b", "shard")).alias(name))


def cascade(universe: DataFrame, listed: DataFrame, per_shard: int = PER_SHARD, broadcast_bytes: int = BROADCAST_BYTES) -> Filter:
    """The filter of the keys of listed, exact for every key of universe. Both have one column of keys."""
    every = universe.select(F.col(universe.columns[0]).cast("string").alias("k"), F.lit(0).alias("on"))
    some = listed.select(F.col(listed.columns[0]).cast("string").alias("k"), F.lit(1).alias("on"))
    keys = every.union(some).where("k is not null").groupBy("k").agg(F.max("on").alias("on"))
    keys = materialize(keys.select(*_hashes(F.col("k")), "on"), "universe")
    total, on = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("on"), F.lit(0))).first()
    shards, rate = max(1, math.ceil(on / per_shard)), first_rate(on, total)
    keys = keys.withColumn("shard", _shard(shards))

    def level_one(group: pa.Table) -> pa.Table:
        a, b = (_u(group[c].combine_chunks()) for c in "ab")
        blob = Level.of(a, b, 1, rate).packed()
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "depth": pa.array([1], pa.int32()), "blob": pa.array([blob], pa.binary())})

    fields = "shard int, depth int, blob binary"
    first = materialize(keys.where("on = 1").groupBy("shard").applyInArrow(level_one, fields), "level1")
    size = first.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    passed = _through(keys.where("on = 0"), first, shards, size, broadcast_bytes)

    def deeper(group: pa.Table) -> pa.Table:
        a, b, is_on = (group[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b", "on"))
        a, b, is_on = a.view(U), b.view(U), is_on == 1
        made = Cascade.deeper((a[is_on], b[is_on]), (a[~is_on], b[~is_on]))
        blobs = [x.packed() for x in made.levels] + ([made.rest.astype("<u8").tobytes()] if len(made.rest) else [])
        depths = [x.depth for x in made.levels] + [0] * bool(len(made.rest))
        shard = group["shard"][0].as_py()
        return pa.table({"shard": pa.array([shard] * len(blobs), pa.int32()), "depth": pa.array(depths, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    rest = keys.where("on = 1").unionByName(passed).groupBy("shard").applyInArrow(deeper, fields)
    table = materialize(first.unionByName(rest), "cascade")
    size = table.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    return Filter(table, shards, size, broadcast_bytes)


def _through(keys: DataFrame, first: DataFrame, shards: int, size: int, broadcast_bytes: int) -> DataFrame:
    """The keys (a, b, on, shard) that level 1 lets through."""
    sent = None
    if size <= broadcast_bytes:
        sent = keys.sparkSession.sparkContext.broadcast({r["shard"]: Level.unpacked(bytes(r["blob"])) for r in first.collect()})
    else:
        keys = keys.repartitionByRange(exchange_partitions(keys.sparkSession), "shard", "a")
    folder = None if sent is not None else first.inputFiles()[0].rsplit("/", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shard = _u(batch.column(0)), _u(batch.column(1)), batch.column(3).to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for k in np.unique(shard).tolist():
                level = sent.value.get(k) if sent is not None else _opened(_read_shard(folder, k))[0]
                if level is not None:
                    at = np.flatnonzero(shard == k)
                    ok[at] = level.passes(a[at], b[at])
            yield batch.filter(pa.array(ok))

    return keys.mapInArrow(trimmed(run), keys.schema)


def judge(df: DataFrame, rules: dict[str, str], listed: DataFrame, url_col: str = "url", host_col: str = "host", path_col: str = "path", rule_col: str = "rule", verdict_col: str = "verdict", **sizes: int) -> DataFrame:
    """df with host, path, the rule that decides (else null) and the verdict: the rule's, else block for listed hosts.

    Args:
        rules: verdict (allow or block) by host/path prefix; the longest that fits decides. A short list, kept in the plan.
        listed: one column of host names; its size has no bound.
    """
    mark = "_listed"
    while mark.lower() in [c.lower() for c in (*df.columns, host_col, path_col, rule_col, verdict_col)]:
        mark += "_"
    df, moved = aside(df, (host_col, path_col, rule_col, verdict_col))
    url = F.col(moved.get(url_col, url_col))
    names = cascade(df.select(host_of(url).alias("k")), listed, **sizes)
    out = df.withColumns({host_col: host_of(url), path_col: path_of(url)})
    out = names.mark(out.withColumn(rule_col, rule_for(F.col(host_col), F.col(path_col), list(rules))), F.col(host_col), mark)
    said = F.when(F.col(mark), "block").otherwise("allow")
    for rule, verdict in rules.items():
        said = F.when(F.col(rule_col) == rule, verdict).otherwise(said)
    return out.withColumn(verdict_col, said).drop(mark)
