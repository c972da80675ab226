"""Named parts that users add to: arms, retrievers, evaluators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

T = TypeVar("T", bound=Callable)


class Registry(Generic[T]):
    """Functions by name, in order of registration. A second function of a name, a nameless one and what cannot be called are errors."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def add(self, name: str, function: T) -> T:
        if not isinstance(name, str) or not name.strip():
            raise ValueError(f"a {self.kind} needs a name")
        if not callable(function):
            raise TypeError(f"{self.kind} {name!r} is no function")
        if name in self._known:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._known[name] = function
        return function

    def __getitem__(self, name: str) -> T:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind} {name!r}: one of {', '.join(self._known)}")
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)

    def __contains__(self, name: str) -> bool:
        return name in self._known
