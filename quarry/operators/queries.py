"""Query transformation: decomposition, stepping back, variants, routing, refinement, hypotheses."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import KEYWORD_STOP, strip, tokens
from quarry.operators import dense
from quarry.operators.embed import Encoder

CONJUNCTIONS = r"(?i)\b(?:and also|and then|and|as well as|in addition to)\b"
ASKING = "are can could did do does how is should was were what when where which who why will would".split()
#: The word that stands for each word.
SYNONYMS = dict(
    pair.split("=")
    for pair in """bad=poor best=top big=large change=modify different=various example=instance fast=quick find=discover
good=effective help=assist important=critical improve=enhance make=create problem=issue show=demonstrate
small=tiny use=utilize way=method""".split()
)


def decompose(query: Column) -> Column:
    """Parts between conjunctions and sentence ends, of 5 characters or more; questions get their mark back."""
    pieces = F.flatten(F.transform(F.split(query, CONJUNCTIONS), lambda p: F.split(strip(p), r"[.?!;]\s*")))
    pieces = F.filter(F.transform(pieces, strip), lambda p: F.length(p) >= 5)
    first = lambda p: F.element_at(F.split(F.lower(p), r"\s+"), 1)
    pieces = F.transform(pieces, lambda p: F.when(first(p).isin(*ASKING), F.concat(p, F.lit("?"))).otherwise(p))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(query))


_DATES = (r"(?i)\bin \d{4}\b", r"(?i)\bon \w+ \d{1,2},? \d{4}\b", r"(?i)\bspecifically\b", r"(?i)\bexactly\b")
_SCAFFOLDS = (r"(?i)^can you (?:tell me |explain )?", r"(?i)^(?:please )?(?:tell me |explain )", r"(?i)^I (?:want|need) to (?:know|understand) ")


def step_back(query: Column, rules: tuple[tuple[str, str], ...] | None = None) -> Column:
    """A broader form: no dates, one generalisation, no scaffolding; a query that stays the same gets a broad frame.

    rules: (pattern, replacement) pairs, of which the first that matches applies.
    """
    given = GENERALISE if rules is None else rules
    plain = reduce(lambda q, p: F.regexp_replace(q, p, ""), _DATES, query)
    plain = strip(F.regexp_replace(plain, r"\s{2,}", " "))
    general = plain
    for pattern, replacement in reversed(given):
        general = F.when(plain.rlike(pattern), F.regexp_replace(plain, pattern, replacement)).otherwise(general)
    core = reduce(lambda q, p: F.regexp_replace(q, p, ""), _SCAFFOLDS, general)
    core = F.when(strip(core) != "", strip(core)).otherwise(general)
    framed = F.concat(F.lit("What are the general principles behind "), strip(F.regexp_replace(query, r"\?+$", "")), F.lit("?"))
    return F.when(core == query, framed).otherwise(core)


#: The last pattern takes the whole query, as its replacement stands for all of it.
GENERALISE = ((r"(?i)^(what|how)\b.*?\b(specific|particular)\b", "general"), (r"(?i)^why did (.+?) (?:in|on|at|during)\b.*$", "why does $1"))


def _bare(query: Column) -> Column:
    return F.regexp_replace(strip(query), r"\?+$", "")


def synonym(query: Column) -> Column:
    """The first word with a synonym replaced by it; capitals and closing signs stay."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    key = lambda w: F.regexp_replace(F.lower(w), r"[.,?!;:]+$", "")
    at = F.array_position(F.transform(words, lambda w: key(w).isin(*SYNONYMS)), True).cast("int")
    word = F.element_at(words, F.when(at > 0, at))
    choice = F.element_at(known, key(word))
    choice = F.when(F.left(word, F.lit(1)).rlike(r"\p{Lu}"), F.concat(F.upper(F.left(choice, F.lit(1))), F.substring(choice, 2, 1000))).otherwise(choice)
    new = F.concat(choice, F.substring(word, F.length(key(word)) + 1, F.length(word)))
    swapped = F.array_join(F.transform(words, lambda w, i: F.when(i == at - 1, new).otherwise(w)), " ")
    return F.when(at > 0, swapped).otherwise(query)


REPHRASE = ((r"(?i)^what is (.+)", "explain $1"), (r"(?i)^how (?:do|does|can) (.+?) (.+)", "what is the process for $1 to $2"), (r"(?i)^why (?:do|does|is|are) (.+)", "what is the reason that $1"), (r"(?i)^explain (.+)", "what is $1"))


def rephrase(query: Column) -> Column:
    out = query
    for pattern, replacement in reversed(REPHRASE):
        out = F.when(_bare(query).rlike(pattern), F.concat(strip(F.regexp_replace(_bare(query), pattern, replacement)), F.lit("?"))).otherwise(out)
    return out


def perspective(query: Column) -> Column:
    bare = _bare(query)
    rest = F.when(bare.rlike(r"^\S+\s+\S"), F.regexp_replace(bare, r"^\S+\s+", "")).otherwise(bare)
    asks = bare.rlike(r"(?i)^(what|how|why|when|where|who)\b")
    return F.when(asks, F.concat(F.lit("Describe the key aspects of "), rest, F.lit("?"))).otherwise(F.concat(F.lit("What should someone know about "), bare, F.lit("?")))


def keywords(query: Column) -> Column:
    words = F.filter(tokens(query, KEYWORD_STOP), lambda w: F.length(w) > 2)
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise(query)


def first_of_each(items: Column) -> Column:
    """items without those that an earlier one equals but for case and blanks around."""
    keys = F.transform(items, lambda v: F.lower(strip(v)))
    return F.filter(items, lambda v, i: F.array_position(keys, F.lower(strip(v))) == i + 1)


def variants(query: Column, most: int = 3) -> Column:
    """The query, then its synonym, rephrased, shifted and keyword forms, without repeats."""
    return F.slice(first_of_each(F.array(query, synonym(query), rephrase(query), perspective(query), keywords(query))), 1, most)


TYPES = (("factual", r"(?i)^(who|what|when|where)\b.*\??\s*$"), ("procedural", r"(?i)^how\b.*\??\s*$"), ("conceptual", r"(?i)\b(explain|describe|what is|define|concept)\b"), ("comparative", r"(?i)\b(compare|difference|versus|vs\.?|better|worse)\b"), ("causal", r"(?i)^why\b.*\??\s*$"))


def classify(query: Column) -> Column:
    """The first type whose pattern fits, else general."""
    out = F.lit("general")
    for name, pattern in reversed(TYPES):
        out = F.when(query.rlike(pattern), name).otherwise(out)
    return out


class Router:
    """Sends each query to the retriever of its type: functions from a query table to (qid, rank, id, score)."""

    def __init__(self, retrievers: Mapping[str, Callable[[DataFrame], DataFrame]], routes: Mapping[str, str] | None = None):
        if not retrievers:
            raise ValueError("a router needs a retriever")
        self.retrievers, self.default = dict(retrievers), next(iter(retrievers))
        self.routes: dict[str, str] = {}
        for kind, name in (routes or {}).items():
            self.route(kind, name)

    def route(self, kind: str, name: str) -> None:
        if name not in self.retrievers:
            raise ValueError(f"unknown retriever {name!r}")
        self.routes[kind] = name

    def assign(self, queries: DataFrame, query_col: str = "query") -> DataFrame:
        """queries with type and retriever."""
        target = F.lit(self.default)
        for kind, name in self.routes.items():
            target = F.when(F.col("type") == kind, name).otherwise(target)
        return queries.withColumn("type", classify(F.col(query_col))).withColumn("retriever", target)

    def search(self, queries: DataFrame, query_col: str = "query") -> DataFrame:
        assigned = self.assign(queries, query_col)
        return reduce(DataFrame.unionByName, (run(assigned.where(F.col("retriever") == name)) for name, run in self.retrievers.items()))


def sub_questions(query: Column) -> Column:
    """The question, its parts at conjunctions, and what a comparison compares; without repeats."""
    found = F.array(query)
    for word in ("and", "also", "additionally", "furthermore"):
        parts = F.transform(F.split(query, f"(?i) {word} "), lambda p: F.concat(strip(F.regexp_replace(strip(p), r"\?+$", "")), F.lit("?")))
        parts = F.filter(parts, lambda p: F.length(p) > 10)
        found = F.concat(found, F.when(F.contains(F.lower(query), F.lit(f" {word} ")), parts).otherwise(F.array().cast("array<string>")))
    compared = r"(?i)(?:compare|difference|versus|vs\.?)\s+(.+?)\s+(?:and|with|vs\.?)\s+(.+)"
    side = lambda k: F.concat(F.lit("What is "), F.regexp_replace(strip(F.regexp_extract(query, compared, k)), r"\?+$", "") if k == 2 else strip(F.regexp_extract(query, compared, k)), F.lit("?"))
    found = F.concat(found, F.when(query.rlike(compared), F.array(side(1), side(2))).otherwise(F.array().cast("array<string>")))
    return first_of_each(found)


def refine(query: Column, turn: Column | int) -> Column:
    """The form of the query that a corrective turn searches for; turns go round three forms."""
    forms = F.array(F.concat(F.lit("detailed explanation of "), query), F.concat(F.lit("specifically about "), query, F.lit(" key concepts")), F.concat(query, F.lit(" comprehensive overview")))
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.element_at(forms, (turn % 3 + 1).cast("int"))


#: Hypothetical answers, by template; {} is the query.
HYPOTHESES = ("{}", "The answer to the question '{}' is as follows.", "A passage about the following topic: {}")


def hypotheses(queries: DataFrame, count: int = 3, qid_col: str = "qid", query_col: str = "query", templates: tuple[str, ...] = HYPOTHESES) -> DataFrame:
    """(qid, h, hypothesis): the first count templates filled with each query."""
    made = F.array(*(F.concat(F.lit(t.partition("{}")[0]), F.col(query_col), F.lit(t.partition("{}")[2])) for t in templates[:count]))
    return queries.select(F.col(qid_col).alias("qid"), F.posexplode(made).alias("h", "hypothesis"))


def imagined(load: Callable[[], Callable[[str], str]], count: int = 3, templates: tuple[str, ...] = HYPOTHESES) -> Callable[[DataFrame], DataFrame]:
    """A maker of (qid, h, hypothesis) by a model from prompt to text, loaded once a worker; a call that fails falls back to the template."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for prompts in batches:
            out = []
            for p in prompts.to_pylist():
                try:
                    out.append(model(p) or p)
                except Exception:  # whatever a model raises
                    out.append(p)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lambda queries: hypotheses(queries, count, templates=templates).withColumn("hypothesis", F.arrow_udf(run, "string")("hypothesis"))


def mean_vectors(rows: DataFrame, qid_col: str = "qid", vector_col: str = "vec") -> DataFrame:
    """(qid, embedding): the mean of each query's vectors."""
    parts = rows.select(F.col(qid_col).alias("qid"), F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    folded = means.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("parts"))
    return folded.select("qid", F.transform("parts", lambda p: p["x"]).alias("embedding"))


def hyde_search(docs: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 5, count: int = 3, id_col: str = "doc_id", vector_col: str = "embedding", generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, rank, id, score) near the mean vector of each query's hypotheses; generate replaces the templates."""
    made = generate(queries) if generate else hypotheses(queries, count)
    vectors = mean_vectors(made.withColumn("vec", encoder.encode(F.col("hypothesis"))))
    return dense.search(docs, vectors, k, id_col=id_col, vector_col=vector_col)
