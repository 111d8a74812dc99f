"""Pipelines as graphs of named steps, whose ports are DataFrames.

A pipeline is declared in Python: steps with ports, connected by name. Nothing
runs until a port is read; Catalyst plans everything behind it. Signatures are
checked before any plan is built, with the codes of the standard. Effects
(writing, messages) are kept in a list and run in order.

    p = Pipeline("source")
    p.step("lines", lambda source: select(parse(source), element("line")))
    p.step("n", lambda source: count(source), source="lines")
    p.run(source=orders)["n"].show()
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from seqloom.functions.errors import check

Outputs = DataFrame | dict[str, DataFrame]


@dataclass
class Step:
    """A named step: a function of input ports and options, and what its ports are bound to."""

    name: str
    body: Callable[..., Outputs]
    bindings: dict[str, str]
    options: dict
    after: tuple[str, ...] = ()


@dataclass
class Pipeline:
    """Steps by name. inputs: the pipeline's own input ports; required: options that a caller must give."""

    inputs: tuple[str, ...] = ("source",)
    required: tuple[str, ...] = ()
    steps: dict[str, Step] = field(default_factory=dict)
    effects: list[tuple[str, Callable[[DataFrame], None], str]] = field(default_factory=list)
    primary: str | None = None

    def __post_init__(self) -> None:
        if isinstance(self.inputs, str):
            self.inputs = (self.inputs,)
        check(len(set(self.inputs)) == len(self.inputs), "XS0011", "an input port twice")
        self.primary = self.inputs[0] if self.inputs else None

    def step(self, name: str, body: Callable[..., Outputs], options: dict | None = None, after: tuple[str, ...] = (), **bindings: str) -> Pipeline:
        """Add a step. An input port that is not bound reads the step before it (or the pipeline's input).

        A binding is a step's name, or name.port for one of several outputs.
        Name clash: XS0002; unknown port or option: XS0010; missing: XS0018.
        """
        check(name not in self.steps and name not in self.inputs, "XS0002", name)
        known = inspect.signature(body).parameters
        open_ended = any(p.kind == p.VAR_KEYWORD for p in known.values())
        options = options or {}
        for given in (*bindings, *options):
            check(open_ended or given in known, "XS0010", f"{name} has no port or option {given}")
        for p, spec in known.items():
            if spec.kind in (spec.VAR_KEYWORD, spec.VAR_POSITIONAL) or p in bindings or p in options or spec.default is not spec.empty:
                continue
            check(p == next(iter(known)) and self.primary is not None, "XS0018" if self.primary else "XS0032", f"{name}: {p} has no value")
            bindings = {p: self.primary} | bindings
        self.steps[name] = Step(name, body, dict(bindings), options, after)
        self.primary = name
        return self

    def effect(self, name: str, action: Callable[[DataFrame], None], source: str | None = None) -> Pipeline:
        """Add an action on a port that must happen, in the order of declaration, whether or not its output is read."""
        self.effects.append((name, action, source or self.primary or ""))
        return self

    def order(self) -> list[str]:
        """Step names, each after those it reads; unreadable port: XS0022; loop: XS0001."""
        graph = {}
        for s in self.steps.values():
            reads = [b.partition(".")[0] for b in s.bindings.values()]
            for r in (*reads, *s.after):
                check(r in self.steps or r in self.inputs, "XS0022", f"{s.name} reads {r}")
            graph[s.name] = [r for r in (*reads, *s.after) if r in self.steps]
        try:
            return list(TopologicalSorter(graph).static_order())
        except CycleError as x:
            check(False, "XS0001", str(x.args[1]))
            raise

    def run(self, options: dict | None = None, **inputs: DataFrame) -> dict[str, DataFrame]:
        """DataFrames of all ports by name; only what is read of them runs, besides the effects."""
        for p in self.inputs:
            check(p in inputs, "XS0032", f"input port {p} is not bound")
        for o in self.required:
            check(o in (options or {}), "XS0018", f"option {o}")
        ports: dict[str, DataFrame] = dict(inputs)
        for name in self.order():
            s = self.steps[name]
            out = s.body(**{p: ports[b] for p, b in s.bindings.items()}, **{k: v(options or {}) if callable(v) and getattr(v, "late", False) else v for k, v in s.options.items()})
            if isinstance(out, dict):
                ports |= {f"{name}.{p}": d for p, d in out.items()}
                ports[name] = next(iter(out.values()))
            elif out is not None:
                ports[name] = out
        for _, action, source in self.effects:
            check(source in ports, "XS0022", source)
            action(ports[source])
        return ports


def call(pipeline: Pipeline, port: str | None = None) -> Callable[..., DataFrame]:
    """A pipeline as the body of a step of another one: its input ports and required options are the step's.

    port: which of its steps' outputs is the result (the last one's). A
    pipeline may call itself where a condition on options ends it: steps are
    built when they run.
    """

    def body(**given) -> DataFrame:
        inputs = {k: v for k, v in given.items() if k in pipeline.inputs}
        return pipeline.run({k: v for k, v in given.items() if k not in inputs}, **inputs)[port or pipeline.primary]

    kind = inspect.Parameter.KEYWORD_ONLY
    body.__signature__ = inspect.Signature([*(inspect.Parameter(p, kind) for p in (*pipeline.inputs, *pipeline.required)), inspect.Parameter("more", inspect.Parameter.VAR_KEYWORD)])
    return body


def option(name: str, default=None) -> Callable[[dict], object]:
    """A step's option that takes the value of the pipeline's option when it runs."""

    def late(options: dict):
        return options.get(name, default)

    late.late = True
    return late
