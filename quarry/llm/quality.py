"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Every text gives counts, these a vector of transformed statistics. For each (language, source), concentration steps
look for the mean and covariance of the closest part of its rows: distances under the last estimate, the border
that leaves this part inside, moments of the rows inside. They begin at three deterministic starts (medians and
quartiles, all rows, spatial signs about the medians), and the estimate of least determinant stays. All rows count in
every step. Borders come from histograms of the logarithm of distance (to 1/64) and moments from sums, so rows are
pre-aggregated before each exchange and a source with a third of all rows is no task of its own. Estimates of few rows
lean on those of their language, and FLOORS, squared, are added to each variance: a ridge below which spread means
nothing.

Defined results: null or empty text has no words and fails the base rule; null language or source is a group of its
own; groups of any size get estimates; equal rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, trimmed

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIM = 4
#: Part of a group's rows that the estimates must cover.
COVER = 0.75
#: Squared distances beyond this reject: the 1 - 1e-9 quantile of chi-square with DIM degrees.
LIMIT = 47.5
#: Concentration steps.
STEPS = 3
#: A group's estimates weigh as its rows, those of its language as this many.
PRIOR = 40.0
#: Least standard deviation of each transformed statistic: below it a spread means nothing.
FLOORS = (0.06, 0.5, 0.9, 0.8)

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


def counts_of(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line and not line.isspace():
                seen.add(line)
    view = np.frombuffer(raw, np.uint8)
    chars = int(((view & 0xC0) != 0x80).sum() - _space[view].sum())
    symbols = int(_symbol[view].sum())
    repeat = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        if k < n:  # all words differ: no window twice
            key = (ids[:-2] * k + ids[1:-1]) if k > 2_000_000 else (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
            if k > 2_000_000:
                key = np.unique(key, return_inverse=True)[1] * k + ids[2:]
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            same = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(key) + 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = twice.copy()
            hit[1:] |= twice[:-1]
            hit[2:] |= twice[:-2]
            repeat = int(hit.sum())
    return n, chars, symbols, dup, repeat


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, the five counts) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            found = np.array([counts_of(t or b"") for t in texts], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([*batch.columns[:3], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["id", "lang", "source", *COUNTS])

    some = df.select(df[id_col].alias("id"), df[lang_col].cast("string").alias("lang"), df[source_col].cast("string").alias("source"), df[text_col].cast("string").alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    return some.mapInArrow(trimmed(run), f"id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    """The rule before the method: too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: word length, and rates of symbols, repeated lines and repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / words),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.log1p(1000 * F.col("n_dup_lines") / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
GROUP = ["lang", "source"]
RUN = [*GROUP, "start"]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(x).alias(f"s_{x}") for x in X),
        *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i, j in PAIRS),
    )


def _estimates(moments: DataFrame) -> DataFrame:
    """Mean, inverse covariance and logarithm of its determinant of each run, leaning on its language. moments: of runs."""
    own = moments
    total = own.groupBy("lang", "start").agg(*(F.sum(c).alias(f"l_{c}") for c in own.columns if c not in RUN))
    total = total.withColumnsRenamed({"lang": "l_lang", "start": "l_start"})
    both = own.join(total, own["lang"].eqNullSafe(total["l_lang"]) & (own["start"] == total["l_start"])).drop("l_lang", "l_start")
    names = ["n", *(f"s_{x}" for x in X), *(f"q_{i}_{j}" for i, j in PAIRS)]

    def cov(frame, prefix):
        n = np.maximum(frame[f"{prefix}n"].to_numpy(float), 1)[:, None]
        mean = frame[[f"{prefix}s_{x}" for x in X]].to_numpy(float) / n
        c = np.zeros((len(frame), DIM, DIM))
        for i, j in PAIRS:
            c[:, i, j] = c[:, j, i] = frame[f"{prefix}q_{i}_{j}"].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
        return n[:, 0], mean, c

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            n, mean, c = cov(f, "")
            _, l_mean, l_c = cov(f, "l_")
            part = (n / (n + PRIOR))[:, None]
            center = part * mean + (1 - part) * l_mean
            gap = mean - l_mean
            between = (part * (1 - part))[:, :, None] * gap[:, :, None] * gap[:, None, :]
            s = part[:, :, None] * c + (1 - part)[:, :, None] * l_c + between
            # the closest part of normal rows spreads less than all of them: consistency factor for COVER and DIM
            s = s * CONSISTENCY
            s += np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(s)
            out = f[RUN].copy()
            for i in range(DIM):
                out[f"m{i}"] = center[:, i]
            for i, j in PAIRS:
                out[f"p_{i}_{j}"] = inverse[:, i, j] * (1 if i == j else 2)
            out["logdet"] = np.linalg.slogdet(s)[1]
            yield out

    fields = ", ".join(["lang string", "source string", "start int", *(f"m{i} double" for i in range(DIM)), *(f"p_{i}_{j} double" for i, j in PAIRS), "logdet double"])
    return both.select(*RUN, *names, *(f"l_{c}" for c in names)).mapInPandas(run, fields)


def _consistency() -> float:
    """COVER / P(chi-square with DIM + 2 degrees <= the COVER quantile with DIM degrees), by the closed forms for even degrees."""
    cdf4 = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2)
    cdf6 = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2 + x * x / 8)
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf4(mid) < COVER else (low, mid)
    return float(COVER / cdf6(low))


CONSISTENCY = _consistency()


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    p = params.withColumnsRenamed({"lang": "p_lang", "source": "p_source"})
    return rows.join(p, rows["lang"].eqNullSafe(p["p_lang"]) & rows["source"].eqNullSafe(p["p_source"])).drop("p_lang", "p_source")


def _distance() -> Column:
    total = None
    for i, j in PAIRS:
        part = F.col(f"p_{i}_{j}") * (F.col(X[i]) - F.col(f"m{i}")) * (F.col(X[j]) - F.col(f"m{j}"))
        total = part if total is None else total + part
    return F.greatest(total, F.lit(0.0))


def _inside(rows: DataFrame, distance: Column) -> DataFrame:
    """Rows with d2 of which COVER of the run is closest; borders by 1/64 of the distance's logarithm."""
    from pyspark.sql import Window as W

    near = rows.withColumn("bin", F.floor(F.log(distance + 1e-6) * 64).cast("int"))
    by_bin = near.groupBy(*RUN, "bin").agg(F.count(F.lit(1)).alias("rows"))
    w = W.partitionBy(*RUN)  # some hundred bins a run
    bins = by_bin.withColumns({"upto": F.sum("rows").over(w.orderBy("bin")), "all": F.sum("rows").over(w)})
    border = bins.where(F.col("upto") >= F.col("all") * COVER).groupBy(*RUN).agg(F.min("bin").alias("border"))
    border = border.withColumnsRenamed({"lang": "b_lang", "source": "b_source", "start": "b_start"})
    same = near["lang"].eqNullSafe(border["b_lang"]) & near["source"].eqNullSafe(border["b_source"]) & (near["start"] == border["b_start"])
    return near.join(border, same).where(F.col("bin") <= F.col("border"))


def robust(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates per group of rows (lang, source, x0 ...): of least determinant after concentration steps from each start."""
    from pyspark.sql import Window as W

    # start: medians and median deviations per statistic, from histograms
    bins = rows.select(*GROUP, F.posexplode(F.array(*(F.floor(F.col(x) * 128).cast("int") for x in X))).alias("k", "bin"))
    by_bin = bins.groupBy(*GROUP, "k", "bin").agg(F.count(F.lit(1)).alias("rows"))
    w = W.partitionBy(*GROUP, "k")
    parts = by_bin.withColumns({"upto": F.sum("rows").over(w.orderBy("bin")), "all": F.sum("rows").over(w)})
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / 128.0 + 1 / 256
    spots = parts.groupBy(*GROUP, "k").agg(quantile(0.5).alias("mid"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("sd"))
    wide = spots.groupBy(*GROUP).agg(*(F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}{i}") for i in range(DIM) for c in ("mid", "sd")))
    start = wide.select(*GROUP, *(F.col(f"mid{i}").alias(f"m{i}") for i in range(DIM)), *((1 / (F.col(f"sd{i}") * F.col(f"sd{i}") + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"p_{i}_{j}") for i, j in PAIRS))
    start = materialize(start.withColumns({"start": F.lit(0), "logdet": F.lit(float("inf"))}), "mcd")
    # two more starts: moments of all rows, and of their spatial signs in units of the quartiles
    gap = [(F.col(x) - F.col(f"m{i}")) * F.sqrt(f"p_{i}_{i}") for i, x in enumerate(X)]
    length = F.greatest(F.sqrt(sum(g * g for g in gap)), F.lit(1e-12))
    signs = [(F.col(f"m{i}") + g / length / F.sqrt(f"p_{i}_{i}")).alias(X[i]) for i, g in enumerate(gap)]
    forms = F.explode(F.array(F.struct(F.lit(1).alias("start"), *X), F.struct(F.lit(2).alias("start"), *signs))).alias("form")
    more = _estimates(_moments(_with(rows, start.drop("start")).select(*GROUP, forms).select(*GROUP, "form.*"), RUN))
    params, old = materialize(start.unionByName(more.withColumn("logdet", F.lit(float("inf")))), "mcd"), [start]
    for _ in range(steps):
        kept = _inside(_with(rows, params).withColumn("d2", _distance()).select(*RUN, *X, "d2"), F.col("d2"))
        old.append(params)
        params = materialize(_estimates(_moments(kept, RUN)), "mcd")
    for table in old:
        discard(table)
    best = F.row_number().over(W.partitionBy(*GROUP).orderBy("logdet", "start"))  # a row a start
    return params.withColumn("place", best).where("place = 1").drop("place", "start", "logdet")


def judge(df: DataFrame, id_col: str = "doc_id", limit: float = LIMIT, steps: int = STEPS, **columns: str) -> DataFrame:
    """(id_col, the five counts, base_failed, distance2, kept) of every row of df."""
    found = materialize(counts(df, id_col, **columns), "counts")
    rows = found.withColumns(dict(zip(X, vector()))).withColumn("base_failed", base_failed())
    # texts that fail the base rule have statistics of few or repeated words: they describe no group
    params = robust(rows.where(~F.col("base_failed")).select(*GROUP, *X), steps)
    p = params.withColumnsRenamed({"lang": "p_lang", "source": "p_source"})
    scored = rows.join(p, rows["lang"].eqNullSafe(p["p_lang"]) & rows["source"].eqNullSafe(p["p_source"]), "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit)
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "distance2", kept.alias("kept"))
