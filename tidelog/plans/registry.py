"""Exposure registry: named functions over the engine that a caller may run, and no others."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import compose, text_hash
from tidelog.sources.tables import table


class NotExposed(LookupError):
    """The one answer to every name that may not be called, known or not."""

    def __init__(self) -> None:
        super().__init__("no such function")


@dataclass
class Registry:
    """Functions by name; ``never`` shuts a name; ``public`` ones need no login."""

    functions: dict[str, Callable] = field(default_factory=dict)
    public: set[str] = field(default_factory=set)
    never: set[str] = field(default_factory=set)

    def expose(self, f: Callable | None = None, *, public: bool = False) -> Callable:
        def add(g: Callable) -> Callable:
            self.functions[g.__name__] = g
            if public:
                self.public.add(g.__name__)
            return g

        return add if f is None else add(f)

    def identity(self, name: str) -> str:
        """A hash of the name, the arguments' types in order and the result's: another signature is another function."""
        signature = inspect.signature(self.functions[name])
        kinds = [p.annotation for p in signature.parameters.values()] + [signature.return_annotation]
        tags = [text_hash(k if isinstance(k, str) else getattr(k, "__name__", str(k))) for k in kinds]
        return f"{compose(text_hash(name), tags):016x}"

    def call(self, name: str, *args, login: bool = True, fallback: Callable | None = None):
        if name in self.never or name not in self.functions or not (login or name in self.public):
            raise NotExposed
        out = self.functions[name](*args)
        return fallback(*args) if out is None and fallback else out


SHOP = Registry()


@SHOP.expose
def customers_in(spark, sf_dir: str, segment: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == segment).select("c_custkey", "c_name")
