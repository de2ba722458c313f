"""Batch scoring with a model supplied by the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    features: str,
    width: int,
    batch_size: int = 1024,
    name: str = "prediction",
) -> DataFrame:
    """Append the model's output; every column of the row, its key included, stays attached.

    ``make_predict`` builds the model once per worker and returns a function from a batch
    (``rows x width``) to one value per row.
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(name, predict(F.col(features)))
