"""Named parts, found by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Registry:
    def __init__(self, name: str):
        self.name, self._parts = name, {}

    def register(self, name: str | None = None) -> Callable[[Any], Any]:
        """Decorator; the part's own name counts without one. A name twice is an error."""

        def keep(part: Any) -> Any:
            key = name or part.__name__
            if key in self._parts:
                raise ValueError(f"{key!r} is registered in {self.name} already")
            self._parts[key] = part
            return part

        return keep

    def get(self, name: str) -> Any:
        if name not in self._parts:
            raise KeyError(f"{self.name} has no {name!r}; it has {sorted(self._parts)}")
        return self._parts[name]

    def list(self) -> list[str]:
        return sorted(self._parts)

    def __contains__(self, name: str) -> bool:
        return name in self._parts

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)


ENCODERS, RETRIEVERS, GENERATORS, PIPELINES, LOADERS = map(Registry, ("encoders", "retrievers", "generators", "pipelines", "loaders"))


def auto_register() -> None:
    """Fill the registries with the parts of the library; those that are in already stay."""
    from quarry.operators import dense, embed, generate, late, queries, sparse
    from quarry.plans import rag
    from quarry.sources import loaders

    own = (
        (ENCODERS, {"hashing": embed.HashingEncoder, "model": embed.ModelEncoder}),
        (RETRIEVERS, {"dense": dense.search, "bm25": sparse.search, "late": late.search, "hyde": queries.hyde_search}),
        (GENERATORS, {"extractive": generate.extractive, "model": generate.model}),
        (PIPELINES, dict(rag.PLANS)),
        (LOADERS, dict(loaders.READERS)),
    )
    for registry, parts in own:
        for name, part in parts.items():
            if name not in registry:
                registry.register(name)(part)
