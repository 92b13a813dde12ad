"""Transformers for features: fitted once, applied to any frame with the same columns, usable as steps of a pipeline."""

from __future__ import annotations

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RobustScaling(Estimator):
    """Learns median and quartile range of each column, ignoring nulls and what is not finite."""

    def __init__(self, columns: list[str]) -> None:
        super().__init__()
        self.columns = columns

    def _fit(self, dataset: DataFrame) -> RobustScaled:
        points = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        row = dataset.agg(*(F.percentile(_finite(c), points).alias(c) for c in self.columns)).first()  # three numbers a column
        return RobustScaled({c: tuple(row[c] or (0.0, 0.0, 0.0)) for c in self.columns})


class RobustScaled(Transformer):
    """Adds ``<column>_scaled`` (missing values at the median, divided by the quartile range if there is one) and ``<column>_missing``."""

    def __init__(self, quartiles: dict[str, tuple[float, float, float]]) -> None:
        super().__init__()
        self.quartiles = quartiles

    def _transform(self, dataset: DataFrame) -> DataFrame:
        added = {}
        for c, (low, middle, high) in self.quartiles.items():
            added[f"{c}_scaled"] = (F.coalesce(_finite(c), F.lit(middle)) - middle) / ((high - low) or 1.0)
            added[f"{c}_missing"] = _finite(c).isNull().cast("long")
        return dataset.withColumns(added)


def _finite(c: str):
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))
