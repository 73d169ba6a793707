"""Where models plug in: named scalar pandas functions with a default for when there is none.

A model isn't part of the engine; a port says what it takes and gives, and what a
query uses without it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Port:
    """A result type and the value without a model."""

    result: str
    default: object


#: The ports and what they give without a model.
PORTS = {
    "visual_similarity": Port("double", 0.85),
    "adjudicate": Port("double", 1.0),
    "detect_logo": Port("double", 1.0),
    "extract_text": Port("string", ""),
    "embed": Port("array<float>", None),
}

_models: dict[str, Callable[..., pd.Series]] = {}


def register(name: str, model: Callable[..., pd.Series] | None) -> None:
    """Plug a function of pandas series into a port; None takes it out."""
    if name not in PORTS:
        raise KeyError(name)
    if model is None:
        _models.pop(name, None)
    else:
        _models[name] = model


def call(name: str, *columns: Column) -> Column:
    """The model's answer, or the port's default where it is null or there is no model."""
    port = PORTS[name]
    default = F.lit(port.default).cast(port.result)
    if name not in _models:
        return default
    return F.coalesce(_udf(_models[name], port.result, len(columns))(*columns), default)


def _udf(model: Callable[..., pd.Series], result: str, n: int):
    if n == 1:

        @F.pandas_udf(result)
        def one(a: pd.Series) -> pd.Series:
            return model(a)

        return one

    @F.pandas_udf(result)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return model(a, b)

    return two
