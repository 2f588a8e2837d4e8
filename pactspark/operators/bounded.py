"""Configuration tables: small by contract, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 10_000


def configuration(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A table of settings (rules, templates) as literal rows of the plan.

    Settings do not grow with the corpus, so plans may broadcast them; a table of more
    than ``max_rows`` rows is refused rather than treated in another way.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a configuration table has more than {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
