"""H1: vectors of a caller's model, made inside tasks.

``make_model`` takes nothing and returns a function from a list of texts to one vector per
text. It is called once per worker process, when the first batch arrives, and its result is
kept for the later tasks of that process; it travels to the workers, the model does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import ship_package

Model = Callable[[list[str]], Sequence[Sequence[float]]]

_models: dict[str, Model] = {}


def model_of(key: str, make_model: Callable[[], Model]) -> Model:
    """The model of this worker process; only the latest one is kept."""
    if key not in _models:
        _models.clear()
        _models[key] = make_model()
    return _models[key]


def encode(model: Model, texts: pd.Series, batch_rows: int) -> list[list[float]]:
    out: list[list[float]] = []
    for lo in range(0, len(texts), batch_rows):
        some = ["" if t is None else t for t in texts.iloc[lo:lo + batch_rows]]
        vectors = [[float(x) for x in v] for v in model(some)]
        if len(vectors) != len(some):
            raise ValueError(f"the model gave {len(vectors)} vectors for {len(some)} texts")
        out += vectors
    if len({len(v) for v in out}) > 1:
        raise ValueError("the model gave vectors of different lengths")
    return out


def embed(df: DataFrame, text_col: str, make_model: Callable[[], Model], out_col: str = "embedding",
          batch_rows: int = 256) -> DataFrame:
    """``df`` with ``out_col`` (array<float>): the model's vector of every text. A null text
    counts as empty; an input column named ``out_col`` is replaced; rows stay where they are
    (no exchange) and texts cross in Arrow batches, ``batch_rows`` of them to a model call."""
    ship_package(df.sparkSession)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            model = model or model_of(key, make_model)
            yield pd.Series(encode(model, texts, batch_rows), dtype=object)

    udf = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return df.withColumn(out_col, udf(F.col(f"`{text_col}`").cast("string")))
