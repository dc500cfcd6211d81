"""Column functions over text: tokens, sentences, cleaning."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.batches import in_slices

#: Word characters of any script; the JVM's own class for words is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: A sentence ends after one of these, before white space.
SENTENCE_END = r"(?<=[.!?])\s+"
#: White space as the JVM's patterns know it.
BLANKS = " \t\n\x0b\f\r"
_blanks = re.compile(r"\s+")

_articles = "a an the"
_links = "and or as at by for from in of on to with"
_be = "are be been being is was were"
#: Words that the sparse index skips.
INDEX_STOP = frozenset(f"{_articles} {_links} {_be} it that this can could did do does had has have may might should will would but if no nor not so than then".split())
#: Words of a question that say nothing of its topic.
QUESTION_STOP = frozenset(f"{_articles} and as at by did do does for how in is it of on or to what when where which who why with ?".split())
#: Words that the answer metrics skip.
CONTENT_STOP = frozenset(f"{_articles} {_links} {_be} also any but can did do does had has have how if it its just more no not now should so some than that these this those too very what when where which who why will".split() + list("?.,!;:'\""))
#: Words that a keyword query drops.
KEYWORD_STOP = frozenset(f"{_articles} {_links} are be been is was were can could did do does had has have how it should that this what when where which who why would".split())


def _outside(words: Column, stop: frozenset[str] | None) -> Column:
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(*sorted(stop)))


def tokens(text: Column, stop: frozenset[str] | None = None) -> Column:
    """Lower-cased words of any script, without those in stop; null for null."""
    return _outside(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), stop)


def blank_tokens(text: Column) -> Column:
    """Lower-cased parts between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def content_set(text: Column) -> Column:
    """Distinct words that carry content."""
    return F.array_distinct(tokens(text, CONTENT_STOP))


def blank_set(text: Column) -> Column:
    return F.array_distinct(blank_tokens(text))


def strip(text: Column) -> Column:
    """Without white space around, by a scan of the ends: a pattern would try every blank inside."""
    return F.btrim(text, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Stripped sentences, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def clean(text: Column) -> Column:
    """Unix line ends, at most one blank line, single blanks, no blanks around."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(lines, r"[ \t]{2,}|\t", " "))  # single blanks stay as they are


#: The entities that html_text decodes.
ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&reg;": "®", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def _decoded(text: Column) -> Column:
    """All entities decoded as in HTML 5, then single blanks for any white space; in Python, in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: pa.array([None if t is None else _blanks.sub(" ", unescape(t)).strip() for t in part], pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text)


def html_to_text(html: Column, entities: dict[str, str] | None = None) -> Column:
    """Visible text: no scripts, styles or tags, entities decoded, single blanks.

    Decoded are all entities, also those that lack their end, or only those given, to the letter and one after the other.
    """
    if entities is None:
        bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
        return _decoded(F.regexp_replace(bare, r"<[^>]+>", " "))
    bare = html
    for part in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"):
        bare = F.regexp_replace(bare, part, " ")
    for name, sign in entities.items():
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(bare, r"[\t\n\f\r \xA0]+", " "))


def overlap(a: Column, b: Column) -> Column:
    """Size of the common part of two arrays as sets."""
    return F.size(F.array_intersect(a, b))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
