"""A database: a folder of Parquet tables with declared types, and views in the session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom import schema
from binloom.operators.relational import set_where, united


class Database:
    """Tables are folders below one path. Each change writes a new version and then switches to it, so readers never see half a table."""

    def __init__(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if overwrite:
            self._fs.delete(self._Path(self.path), True)
        self._fs.mkdirs(self._Path(self.path))

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    # catalog
    def tables(self) -> list[str]:
        """Names of tables and of the session's views."""
        stored = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path)) if not s.getPath().getName().startswith("_")]
        return sorted({*stored, *(t.name for t in self.spark.catalog.listTables() if t.isTemporary)})

    def exists(self, name: str, raise_error: bool = False) -> bool:
        found = name in self.tables()
        if raise_error and not found:
            raise ValueError(f"there is no table {name}")
        return found

    def types(self, name: str) -> dict[str, str]:
        return dict(self.table(name).dtypes)

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def count(self, name: str) -> int:
        return self.table(name).count()

    def show(self, name: str, rows: int = 20) -> None:
        self.table(name).show(rows, truncate=False)

    # reading
    def table(self, name: str, fields: list[str] | None = None, order_by: str | None = None) -> DataFrame:
        if self._fs.exists(self._Path(self._at(name))):
            df = self.spark.read.parquet(self._at(name))
        else:
            df = self.spark.table(name)
        df = df.select(*fields) if fields else df
        return df.orderBy(F.col(order_by).asc()) if order_by else df

    def sql(self, text: str) -> DataFrame:
        """A query in SQL over the tables, which are views of the session while it is planned."""
        for name in self.tables():
            if self._fs.exists(self._Path(self._at(name))):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    # definition and changes
    def create(self, name: str, columns: list[str], types: list[str]) -> None:
        """An empty table with columns of the types "int", "float" and "str"."""
        self._store(name, self._empty(T.StructType([T.StructField(c, schema.SCALARS[t]) for c, t in zip(columns, types, strict=True)])), "errorifexists")

    def create_known(self, name: str) -> None:
        """One of the engine's own tables, empty, in place of any other."""
        self._store(name, self._empty(schema.TABLES[name]), "overwrite")

    def _empty(self, kinds: T.StructType) -> DataFrame:
        """No rows, made without Python workers, which createDataFrame() starts."""
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])

    def store(self, name: str, rows: DataFrame) -> None:
        """Append rows, cast to the table's types; a value that can't be cast raises, no rows change nothing."""
        target = self.table(name).schema
        self._store(name, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target]), "append")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A table anew, also from rows that read it."""
        new = self._at(f"_new_{name}")
        rows.write.mode("overwrite").parquet(new)
        self.drop(name)
        self._fs.rename(self._Path(new), self._Path(self._at(name)))
        self.spark.catalog.refreshByPath(self._at(name))

    def _store(self, name: str, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).parquet(self._at(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self._Path(self._at(name)), True)

    def create_view(self, name: str, table: str, where: dict[str, object]) -> None:
        """A view of the rows whose columns equal given values."""
        condition = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in where.items()], F.lit(True))
        self.table(table).filter(condition).createOrReplaceTempView(name)

    def create_top_view(self, name: str, table: str, column: str, n: int) -> None:
        """A view of the n rows with the least values of a column, of equal ones those whose other columns are least."""
        df = self.table(table)
        df.orderBy(F.col(column).asc(), *[c for c in df.columns if c != column]).limit(n).createOrReplaceTempView(name)

    def drop_view(self, name: str) -> None:
        """A view that doesn't exist raises."""
        if not self.spark.catalog.dropTempView(name):
            raise ValueError(f"there is no view {name}")

    def add_columns(self, name: str, columns: dict[str, str], check: bool = True) -> None:
        """New columns of NULLs; with check, those that exist are left as they are."""
        df = self.table(name)
        for c, t in columns.items():
            if c in df.columns:
                if check:
                    continue
                raise ValueError(f"{name} has a column {c}")
            df = df.withColumn(c, F.lit(None).cast(schema.SCALARS[t]))
        self.replace(name, df)

    def drop_columns(self, name: str, columns: list[str]) -> None:
        self.replace(name, self.table(name).drop(*columns))

    def update(self, name: str, values: dict[str, object], where: dict[str, object]) -> None:
        self.replace(name, set_where(self.table(name), values, where))

    def merge(self, others: list[Database], name: str) -> None:
        """One table of several databases, columns matched by name."""
        self.replace(name, united([o.table(name) for o in others]))
