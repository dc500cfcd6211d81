import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quarry.llm import jaccard, mixing, pii, quality, queries


def test_run_is_its_stages(spark, sf):
    """run() against the operators applied one by one, each against what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert len(kept) > 0.7 * len(rows)
    left = docs.where(docs.doc_id.isin(*kept))
    heads = {r.doc_id for r in jaccard.link(left).collect() if r.component_id == r.doc_id}
    left = left.where(left.doc_id.isin(*heads))
    weights = pii.train()
    clean = {i: pii.masked(rows[i]["text"], pii.all_spans(rows[i]["text"], weights)[1]) for i in heads}
    changed = spark.createDataFrame([(i, t, rows[i]["lang"], rows[i]["source"], len(t)) for i, t in clean.items()], docs.schema)
    times = {r.id: r.times for r in mixing.mix(queries.weighed(changed, sf)).collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items() for _ in range(times[i]))
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_take_odd_and_no_rows(spark, sf, docs, none):
    for rows in (docs, none):
        now = rows.select(*corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == corpus_pipeline.COLUMNS
            now = spark.createDataFrame(now.collect(), now.schema)
    assert now.count() == 0


def test_names(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_a_cluster_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Else the join's time grows as the square of the input, and the stages after it have none left."""
    from quarry.llm import jaccard

    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[: i % 190] + [f"u{i}"] + base[i % 190 + 1 :]), "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    monkeypatch.setattr(jaccard, "SAMPLED", 8)
    made, listed = [], jaccard._group_pairs
    monkeypatch.setattr(jaccard, "_group_pairs", lambda *a: made.append(listed(*a).cache()) or made[-1])
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [0]
    assert made[0].count() < 300
