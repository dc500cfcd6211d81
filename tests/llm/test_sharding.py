import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import sharding


def plain(rows, limit):
    bits = lambda k: bin(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:16], 16))[2:].zfill(64)
    keyed = [(bits(k), len((t or "").encode())) for k, t in rows]
    out = {}

    def split(prefix, some):
        total = sum(n for _, n in some)
        if total <= limit or len(prefix) == 64:
            out.update({b: (prefix, total) for b, _ in some})
            return
        for bit in "01":
            split(prefix + bit, [x for x in some if x[0].startswith(prefix + bit)])

    split("", keyed)
    return sorted(((k is None, k or 0), *out[bits(k)]) for k, _ in rows)


@pytest.mark.parametrize("limit", [1_000, 20_000, 10_000_000])
@pytest.mark.parametrize("step", [2, 12])
def test_odd_rows(docs, odd, limit, step):
    found = sharding.assign_shards(docs, limit, shard_col="to", step=step).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.to, r.shard_bytes) for r in found) == plain([r[:2] for r in odd], limit)
    assert all(r.fits == (r.shard_bytes <= limit) and r.shard == "z" for r in found)


def test_one_key_of_many_rows_and_deep_buckets(spark):
    rows = [(7, "h" * 100)] * 50 + [(i, "t" * 30) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sharding.assign_shards(df, 100, step=3).collect()
    assert sorted(((False, r.doc_id), r.shard, r.shard_bytes) for r in found) == plain(rows, 100)
    assert all(r.fits == (r.doc_id != 7) for r in found)


def test_clashing_names_stay(spark):
    names = ["doc_id", "text", "_prefix", "_bits", "_bytes", "_slot", "row", "bits", "at", "slot", "prefix", "SHARD", "shard_bytes", "fits", "fits_", "size"]
    df = spark.createDataFrame([tuple([i, "x" * i, *[f"{n}{i}" for n in names[2:]]]) for i in range(20)], ", ".join(["doc_id bigint", "text string", *(f"{n} string" for n in names[2:])]))
    found = sharding.assign_shards(df, 50).toPandas()
    # those of an added name have _ appended, as often as it takes
    assert list(found.columns) == [{"SHARD": "SHARD_", "shard_bytes": "shard_bytes_", "fits": "fits__"}.get(n, n) for n in names] + ["shard", "shard_bytes", "fits"]
    assert all(found[c].tolist() == [f"{n}{i}" for i in found["doc_id"]] for n, c in zip(names[2:], found.columns[2:]))
    assert sorted(zip([(False, int(i)) for i in found["doc_id"]], found["shard"], found["shard_bytes"])) == plain([(i, "x" * i) for i in range(20)], 50)


def test_no_rows_and_wrong_limit(none):
    assert sharding.assign_shards(none, 10).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(none, 0)


def test_written_shards(spark, tmp_path, docs, odd):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd)
    assert back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.max("shard_bytes").alias("m")).where("n <> m").isEmpty()
