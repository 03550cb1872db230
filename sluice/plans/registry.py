"""Which stages and functions queries can use. Embedders add their own to a copy."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class StageRule:
    """read takes the parser, after the keyword, and returns the stage's parts; compile takes a compiler and the parsed
    stage, and changes the compiler's relation. A source begins a query: its compile sets the relation."""

    keyword: str
    read: Callable[[Any], tuple]
    compile: Callable[[Any, Any], None]
    source: bool = False


@dataclass(frozen=True)
class FunctionRule:
    """compile takes an expression compiler and the call, and returns its step."""

    name: str
    compile: Callable[[Any, Any], Any]


class Registry:
    def __init__(self, stages: Iterable[StageRule] = (), functions: Iterable[FunctionRule] = ()):
        self._stages = {s.keyword.lower(): s for s in stages}
        self._functions = {f.name.lower(): f for f in functions}

    def stage(self, word: str) -> StageRule | None:
        return self._stages.get(word.lower())

    def function(self, word: str) -> FunctionRule | None:
        return self._functions.get(word.lower())

    @property
    def has_functions(self) -> bool:
        return bool(self._functions)

    def with_stages(self, *stages: StageRule) -> Registry:
        return Registry([*self._stages.values(), *stages], self._functions.values())

    def with_functions(self, *functions: FunctionRule) -> Registry:
        return Registry(self._stages.values(), [*self._functions.values(), *functions])
