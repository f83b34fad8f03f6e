"""The extraction as named steps that can be added, switched and configured."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..schema import CodeGraph
from .extract import STEPS, extract


@dataclass
class Step:
    """A step has a name, takes the settings meant for it, and turns a graph into a graph.

    The two steps of STEPS find the graph itself; their work is done by extract(), for which they need no generate.
    """

    name: str
    generate: Callable[[CodeGraph, dict[str, str]], CodeGraph] | None = None
    settings: dict[str, str] = field(default_factory=dict)

    def config(self, settings: dict[str, str]) -> None:
        self.settings = dict(settings)


class Pipeline:
    """Steps in the order in which they were added; each is on until it is switched off by its name."""

    def __init__(self, steps: list[Step] | None = None):
        self.steps: list[Step] = [Step(n) for n in STEPS] if steps is None else list(steps)
        self.off: set[str] = set()

    def add_step(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def enable_step(self, name: str) -> Pipeline:
        self.off.discard(name)
        return self

    def disable_step(self, name: str) -> Pipeline:
        self.off.add(name)
        return self

    def enabled(self) -> list[Step]:
        return [s for s in self.steps if s.name not in self.off]

    def run(self, sources: DataFrame, config: dict[str, str] | None = None, **more) -> CodeGraph:
        """First every enabled step gets the settings, then each does its work, in order; more goes to extract()."""
        on = self.enabled()
        for s in on:
            s.config(config or {})
        graph = extract(sources, steps=tuple(s.name for s in on if s.name in STEPS), **more)
        for s in on:
            if s.generate is not None:
                graph = s.generate(graph, s.settings)
        return graph
