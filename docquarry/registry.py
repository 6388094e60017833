"""Extension points: named tools with hooks and permissions, skills with triggers, model slots, context sources, strategies."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Tool:
    name: str
    description: str
    run: Callable


@dataclass
class ToolRegistry:
    """Tools by name. Hooks run before and after each call; a call that is not permitted, or fails, gives an error row."""

    tools: dict[str, Tool] = field(default_factory=dict)
    before: list[Callable[[str, dict], None]] = field(default_factory=list)
    after: list[Callable[[str, object, float], None]] = field(default_factory=list)
    permitted: set[str] | None = None

    def register(self, name: str, description: str, run: Callable) -> Tool:
        self.tools[name] = Tool(name, description, run)
        return self.tools[name]

    def call(self, name: str, **arguments):
        if self.permitted is not None and name not in self.permitted:
            raise PermissionError(f"tool {name} is not permitted")
        tool = self.tools[name]
        for hook in self.before:
            hook(name, arguments)
        began = time.monotonic()
        out = tool.run(**arguments)
        for hook in self.after:
            hook(name, out, time.monotonic() - began)
        return out

    def dispatch(self, calls: list[dict]) -> list[tuple[str, object, str]]:
        """(name, result, error) of each call of a known tool; unknown ones are left out."""
        out = []
        for c in calls:
            if c.get("name") not in self.tools:
                continue
            try:
                out.append((c["name"], self.call(c["name"], **c.get("args", {})), ""))
            except Exception as e:  # noqa: BLE001  an error is a result here
                out.append((c["name"], None, f"{type(e).__name__}: {e}"))
        return out

    def listing(self) -> str:
        return "\n".join(f"- {t.name}: {t.description}" for t in self.tools.values())


@dataclass
class Skill:
    name: str
    description: str
    trigger: str = "auto"  # default, toggle or auto
    run: Callable | None = None


class SkillRegistry:
    """Skills; a toggled one goes before one that is chosen, and the default takes the rest."""

    def __init__(self):
        self.skills: dict[str, Skill] = {}

    def register(self, skill: Skill) -> None:
        if skill.trigger not in ("default", "toggle", "auto"):
            raise ValueError(f"unknown trigger {skill.trigger}")
        self.skills[skill.name] = skill

    def route(self, toggled: Column, chosen: Column) -> Column:
        """The skill of each request by its columns: toggled, else chosen (if that one may be), else the default."""
        of = lambda kind: [s.name for s in self.skills.values() if s.trigger == kind]
        default = next(iter(of("default")), "")
        return F.when(toggled.isin(*of("toggle")), toggled).when(chosen.isin(*of("auto")), chosen).otherwise(F.lit(default))

    def listing(self) -> str:
        return "\n".join(f"- {s.name}: {s.description}" for s in self.skills.values())


def embedding_slot(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A pandas UDF around an embedding model that ``load`` gives once in each task; null texts are empty."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return embed


def pair_slot(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A pandas UDF around a model that scores pairs of question and text, to be used as ``scorer`` of ``rerank``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype="float64")

    return score


def text_slot(load: Callable[[], Callable[[str], str]], retries: int = 2, wait: float = 1.0):
    """A pandas UDF around a text model: a failed call is tried again after ``wait``, 2 ``wait``, ... seconds, then gives null."""

    def answer(model, prompt: str) -> str | None:
        for attempt in range(retries + 1):
            try:
                return model(prompt)
            except Exception:  # noqa: BLE001  whatever the model raises
                if attempt < retries:
                    time.sleep(wait * (attempt + 1))
        return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series([None if p is None else answer(model, p) for p in prompts], dtype="object")

    return run


class Source(ABC):
    """A source of context: fragments ``(qid, content, priority, age_hours)`` for requests ``(qid, question)``."""

    name: str

    @abstractmethod
    def fragments(self, requests: DataFrame) -> DataFrame: ...


STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    """Register a retrieval strategy: (corpus, queries, k) to a run ``(qid, doc_id, score, rank)``."""

    def add(f):
        STRATEGIES[name] = f
        return f

    return add


def retrieve(name: str, corpus: DataFrame, queries: DataFrame, k: int = 10, **more) -> DataFrame:
    """The run of a strategy for all ``queries(qid, text[, q])`` over ``corpus(doc_id, text[, embedding])``."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](corpus, queries, k, **more).select("qid", "doc_id", "score", "rank")
