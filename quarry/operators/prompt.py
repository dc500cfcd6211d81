"""Prompts: numbered contexts and a question inside a template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """user holds {context} and {question}; contexts are numbered from 1 and joined by separator."""

    name: str
    system: str
    user: str
    separator: str = "\n\n"


_known: dict[str, Template] = {}


def register(template: Template) -> Template:
    _known[template.name] = template
    return template


def get(name: str) -> Template:
    if name not in _known:
        raise ValueError(f"unknown template {name!r}; one of {sorted(_known)}")
    return _known[name]


def names() -> list[str]:
    return list(_known)


register(Template("default", "Answer from the context alone. Say when it is not enough, and cite what you use as [1], [2] and so on.", "Context:\n{context}\n\nQuestion: {question}\n\nAnswer:"))
register(Template("conversational", "Answer in a friendly, natural way from the references, and say so if they miss the topic.", "References:\n\n{context}\n\nUser: {question}\n\nAssistant:"))
register(Template("academic", "Answer with precision. Give a citation like [1] for each claim, and keep your analysis apart from the sources.", "Sources:\n{context}\n\nResearch question: {question}\n\nAnalysis:"))
register(Template("code", "Answer programming questions from the documentation. Show code where it helps, and name documents by number.", "Documentation:\n{context}\n\nQuestion: {question}\n\nAnswer:"))
register(Template("minimal", "", "Given this:\n{context}\n\nAnswer the question: {question}"))


def context(contexts: Column, sources: Column | None = None, separator: str = "\n\n") -> Column:
    """[1] first context, with (source: its source) where sources has one, and so on."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    if sources is not None:
        given = lambda i: F.get(sources, i)
        numbered = F.transform(numbered, lambda c, i: F.when(F.coalesce(given(i), F.lit("")) != "", F.concat(c, F.lit(" (source: "), given(i), F.lit(")"))).otherwise(c))
    return F.array_join(numbered, separator)


def user(question: Column, contexts: Column, template: Template | str = "default", sources: Column | None = None) -> Column:
    made = get(template) if isinstance(template, str) else template
    text = F.replace(F.lit(made.user), F.lit("{question}"), question)
    head, _, tail = made.user.partition("{context}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{question}"), question)
    return F.concat(fill(head), context(contexts, sources, made.separator), fill(tail)) if "{context}" in made.user else text


def render(question: Column, contexts: Column, template: Template | str = "default", sources: Column | None = None) -> Column:
    """The whole prompt: system part, blank line, user part."""
    made = get(template) if isinstance(template, str) else template
    text = user(question, contexts, made, sources)
    return F.concat(F.lit(made.system + "\n\n"), text) if made.system else text


def messages(question: Column, contexts: Column, template: Template | str = "default", sources: Column | None = None) -> Column:
    """Array of (role, content), without an empty system part."""
    made = get(template) if isinstance(template, str) else template
    said = [("system", F.lit(made.system))] if made.system else []
    said.append(("user", user(question, contexts, made, sources)))
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said))
