"""Relational operators as SQL over named inputs.

An operator is a SQL text with a placeholder for each input.  Called with DataFrames it gives a
DataFrame (the text is bound to them, so Catalyst sees one logical plan through any chain of
operators).  ``text`` nests the texts of a chain into one query for another engine; where its
dialect differs, ``other`` has the text for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def nested(sql: str, inputs: dict[str, str]) -> str:
    return sql.format(**{k: f"({v})" if " " in v.strip() else v for k, v in inputs.items()})


class Relation:
    def __init__(self, sql: str, other: str | None = None):
        self.sql, self.other = sql, other or sql

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        spark = next(iter(inputs.values())).sparkSession
        return spark.sql(self.sql, **inputs)

    def text(self, **inputs: str) -> str:
        return nested(self.other, inputs)


class Operator:
    """A function of DataFrames, with the text another engine has for it (none: there is no such text)."""

    def __init__(self, fn: Callable[..., DataFrame], other: str | None = None):
        self.fn, self.other = fn, other

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        return self.fn(**inputs)

    def text(self, **inputs: str) -> str:
        if self.other is None:
            raise ValueError("no text for another engine")
        return nested(self.other, inputs)


class Rules:
    """Rules over the rows of one table: each that holds gives a row of ``keys`` with code, severity, value and threshold.

    Here a row's findings are an array that is unrolled, so the table is read once; the text for another
    engine is a union with a branch for each rule.
    """

    def __init__(self, keys: tuple[str, ...], rules: list[tuple[str, str, str, str, str]]):
        self.keys, self.rules = keys, rules

    def here(self, table: str) -> str:
        made = ", ".join(
            f"CASE WHEN {when} THEN named_struct('code', '{code}', 'severity', {severity}, 'value', CAST({value} AS DOUBLE), 'threshold', CAST({limit} AS DOUBLE)) END" for when, code, severity, value, limit in self.rules
        )
        names = ", ".join(self.keys)
        return f"SELECT {names}, f.code AS code, f.severity AS severity, f.value AS value, f.threshold AS threshold FROM (SELECT {names}, explode(array_compact(array({made}))) AS f FROM {table}) x"

    def there(self, table: str) -> str:
        names = ", ".join(self.keys)
        return " UNION ALL ".join(
            f"SELECT {names}, '{code}' AS code, {severity} AS severity, CAST({value} AS DOUBLE) AS value, CAST({limit} AS DOUBLE) AS threshold FROM {table} WHERE {when}" for when, code, severity, value, limit in self.rules
        )
