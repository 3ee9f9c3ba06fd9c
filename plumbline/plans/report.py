"""The figures of a data report: schema, univariate, bivariate, trends and subject area."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators.correlation import bivariate
from plumbline.operators.domains import column_catalog, infer_domains
from plumbline.operators.profile import profile_schema, schema_summary, univariate_detailed
from plumbline.operators.trends import as_time, date_range, first_date_column, linear_trend, seasonality


@dataclass
class ReportFigures:
    schema: DataFrame
    summary: DataFrame
    univariate: DataFrame
    bivariate: DataFrame
    date_column: str | None
    date_range: DataFrame | None
    trends: DataFrame | None
    domain: DataFrame

    def seasonality(self, df: DataFrame, column: str) -> DataFrame | None:
        return seasonality(as_time(df, self.date_column), self.date_column, column) if self.date_column else None


def report_figures(df: DataFrame, name: str, order_by: Sequence[str]) -> ReportFigures:
    """All report numbers of a table; ``order_by`` breaks ties between equal dates."""
    schema = profile_schema(df, order_by)
    date = first_date_column(df)
    timed = as_time(df, date) if date else df
    ties = [c for c in order_by if c != date]
    return ReportFigures(
        schema, schema_summary(schema), univariate_detailed(df), bivariate(df), date,
        date_range(timed, date) if date else None,
        linear_trend(timed, [date, *ties]) if date else None,
        infer_domains(column_catalog({name: df})),
    )
