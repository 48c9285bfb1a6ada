"""Dataset bundle: a directory of Parquet tables with a one-row description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from panelforge.sources.files import read_parquet, write_parquet

TABLES = (
    "target_train", "target_test", "features_train", "features_test",
    "raw_returns", "pred_result", "order_price", "coefficients",
)


class DatasetBundle:
    """Lazy handle on the tables of one trained data set."""

    def __init__(self, tables: dict[str, DataFrame], params: dict | None = None):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self.tables = dict(tables)
        self.params = dict(params or {})

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def save(self, spark: SparkSession, path: str) -> None:
        for name, df in self.tables.items():
            write_parquet(df, f"{path}/{name}")
        meta = spark.createDataFrame([(json.dumps(sorted(self.tables)), json.dumps(self.params, default=str))],
                                     "tables string, params string")
        write_parquet(meta, f"{path}/_meta_table")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DatasetBundle:
        meta = read_parquet(spark, f"{path}/_meta_table").first()
        names = json.loads(meta["tables"])
        return cls({n: read_parquet(spark, f"{path}/{n}") for n in names}, json.loads(meta["params"]))

    def replace(self, **outputs: DataFrame | None) -> DatasetBundle:
        """New bundle with the given outputs swapped in; ``None`` leaves one as it is."""
        return DatasetBundle({**self.tables, **{k: v for k, v in outputs.items() if v is not None}}, self.params)
