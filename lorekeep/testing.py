"""Given events, when a command or a read, then its outcome: small scenarios for folds and decisions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lorekeep.operators.views import View


class Scenario:
    """fold(log) -> rows; decide(log, commands) -> rows; both take and return DataFrames."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.rows = spark, schema, []

    def given(self, *rows: tuple) -> Scenario:
        self.rows += rows
        return self

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.schema)

    def when(self, act: Callable[[DataFrame], DataFrame]) -> Outcome:
        try:
            return Outcome([tuple(r) for r in act(self.log()).collect()], None)
        except Exception as error:
            return Outcome(None, error)


class ProjectionScenario:
    """Given events and a view, when more events come (once or again), then its rows."""

    def __init__(self, spark: SparkSession, schema: str, view: View) -> None:
        self.spark, self.schema, self.view = spark, schema, view
        self.stored = spark.createDataFrame([], view.schema)

    def when(self, *rows: tuple) -> ProjectionScenario:
        """rows: of the log; the view is applied to them. Rows that it has seen change nothing."""
        self.stored = self.spark.createDataFrame(
            self.view.applied(self.spark.createDataFrame(list(rows), self.schema), self.stored).collect(),
            self.view.schema,
        )
        return self

    def then(self, *rows: tuple) -> ProjectionScenario:
        """rows: view_id, version, value."""
        got = sorted(tuple(r) for r in self.stored.collect())
        assert got == sorted(rows), f"{got} != {list(rows)}"
        return self


class Outcome:
    def __init__(self, rows: list[tuple] | None, error: Exception | None) -> None:
        self.rows, self.error = rows, error

    def then(self, *rows: tuple) -> None:
        if self.error:
            raise self.error
        assert sorted(self.rows, key=repr) == sorted(rows, key=repr), f"{self.rows} != {list(rows)}"

    def then_fails(self, text: str) -> Any:
        assert self.error is not None, f"no failure, but {self.rows}"
        assert text in str(self.error), self.error
        return self.error
