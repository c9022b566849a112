"""Vector tables: encoder hook and normalised storage form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.functions.vectors import l2

Encoder = Callable[[list[str]], np.ndarray]


def encode(df: DataFrame, fn: Encoder, in_col: str, out_col: str = "vec") -> DataFrame:
    """Add a vector column computed by ``fn`` from batches of text.

    ``fn`` maps a list of texts to an (n, d) array. It is called once per Arrow batch inside the
    tasks, so a model that it loads lazily is loaded once per Python worker.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.asarray(fn(texts.tolist()), dtype=np.float32)
            yield pd.Series(list(vectors))

    return df.withColumn(out_col, run(F.col(in_col)))


def build_vectors(log: DataFrame, encoder: Encoder | None = None, vec: str = "vec") -> DataFrame:
    """The stored vector table: (market, id, unit float vector). Without an encoder ``log`` brings
    the raw vectors itself, in column ``vec``."""
    encoded = encode(log, encoder, "normalized_query", vec) if encoder else log
    return encoded.select("market", "id", l2(F.col(vec)).alias("vec"))
