"""What query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Book:
    """Queries by name, with the SQL that says the same, or None."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None, **types: str):
        """types: columns of the SQL whose type differs between the engines, and the type that they get."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                told = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items())
                self.oracles[f.__name__] = f"SELECT * REPLACE ({told}) FROM ({sql})" if types else sql
            return f

        return put
