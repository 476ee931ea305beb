"""Sources and sinks: Parquet / CSV / catalog tables, JDBC databases, predictions out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# URL scheme of a database source and the public JDBC driver class that reads it.
JDBC_DRIVERS = {
    "jdbc:postgresql:": "org.postgresql.Driver",
    "jdbc:mysql:": "com.mysql.cj.jdbc.Driver",
}
ROWS_PER_SLICE = 1_000_000  # rows that one task reads from a database
FILE_FORMATS = {".parquet": "parquet", ".csv": "csv", ".orc": "orc", ".json": "json"}


class SourceError(ValueError):
    """The source is of a kind nobody here can read."""


@dataclass(frozen=True)
class JdbcSource:
    """A table of a PostgreSQL or MySQL database, read in parallel slices of a numeric column."""

    url: str
    table: str
    schema: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    partition_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int = 1
    fetch_size: int = 10_000

    def options(self) -> dict[str, str]:
        driver = next((d for p, d in JDBC_DRIVERS.items() if self.url.startswith(p)), None)
        if driver is None:
            raise SourceError(f"no JDBC driver for {self.url.split('//')[0]!r}")
        schema = self.schema
        if schema is None and self.url.startswith("jdbc:postgresql:"):
            schema = "public"
        opts = {
            "url": self.url,
            "dbtable": f"{schema}.{self.table}" if schema else self.table,
            "driver": driver,
            "fetchsize": str(self.fetch_size),
        }
        if self.url.startswith("jdbc:mysql:"):
            opts["sessionInitStatement"] = "SET SESSION sql_mode = 'ANSI_QUOTES'"
        if self.user is not None:
            opts["user"] = self.user
        if self.password is not None:
            opts["password"] = self.password
        if self.partition_column is not None:
            if self.lower is None or self.upper is None:
                raise SourceError("a partition column needs lower and upper bounds")
            opts |= {
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower),
                "upperBound": str(self.upper),
                "numPartitions": str(self.partitions),
            }
        return opts


    def listing_options(self) -> dict[str, str]:
        """Options that read the list of columns of the source's schema."""
        opts = replace(self, partition_column=None).options()
        del opts["dbtable"]
        return opts | {"query": columns_query(self)}


Source = str | JdbcSource | DataFrame


def read_table(spark: SparkSession, source: Source) -> DataFrame:
    """One table, lazily: a DataFrame, a JDBC source, a file path by suffix or a catalog name."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, JdbcSource):
        return spark.read.format("jdbc").options(**source.options()).load()
    suffix = PurePosixPath(source.rstrip("/")).suffix.lower()
    if suffix in FILE_FORMATS:
        reader = spark.read.format(FILE_FORMATS[suffix])
        return (reader.option("header", True) if suffix == ".csv" else reader).load(source)
    if "://" in source or "/" in source:
        raise SourceError(f"cannot tell the format of {source!r}")
    return spark.table(source)


def load_tables(spark: SparkSession, sources: Mapping[str, Source]) -> dict[str, DataFrame]:
    """Every table by name, in name order, with types normalised. Nothing is read yet."""
    return {name: normalise(read_table(spark, sources[name])) for name in sorted(sources)}


# -- what a source holds -----------------------------------------------------------------------


def folder_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name to path of every readable file or directory of a folder, in name order.

    The folder is listed through Spark's own file systems, so it may be anywhere that Spark reads.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [PurePosixPath(entry.getPath().getName()) for entry in listed]
    return {n.stem: f"{folder.rstrip('/')}/{n}" for n in sorted(names, key=lambda n: n.stem) if n.suffix.lower() in FILE_FORMATS}


def catalog_tables(spark: SparkSession, database: str) -> dict[str, str]:
    """Table name to qualified name of every table of a catalog database, in name order."""
    return {t.name: f"`{database}`.`{t.name}`" for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name) if not t.isTemporary}


def columns_query(source: JdbcSource) -> str:
    """The SQL that lists a database schema: tables by name, columns by position."""
    schema = "DATABASE()" if source.schema is None and source.url.startswith("jdbc:mysql:") else f"'{source.schema or 'public'}'"
    return (
        "SELECT table_name AS table_name, ordinal_position AS position, column_name AS column_name, data_type AS type"
        f" FROM information_schema.columns WHERE table_schema = {schema}"
    )


def jdbc_tables(spark: SparkSession, source: JdbcSource) -> dict[str, JdbcSource]:
    """Every table of the schema that ``source`` points into, in name order, read as ``source`` is."""
    options = source.listing_options()
    names = spark.read.format("jdbc").options(**options).load().select("table_name").distinct().orderBy("table_name").collect()
    return {r["table_name"]: replace(source, table=r["table_name"], partition_column=None) for r in names}


def load_source(spark: SparkSession, source: str | JdbcSource) -> dict[str, DataFrame]:
    """All tables of a folder, a catalog database or a database schema. Nothing but its listing is read yet."""
    if isinstance(source, JdbcSource):
        return load_tables(spark, jdbc_tables(spark, source))
    return load_tables(spark, folder_tables(spark, source) if "/" in source else catalog_tables(spark, source))


def describe_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, position, column_name, type, n_rows)``: columns by position, from 0, of tables by name."""
    session = next(iter(tables.values())).sparkSession
    facts = [(name, i, f.name, f.dataType.simpleString()) for name in sorted(tables) for i, f in enumerate(tables[name].schema.fields)]
    listed = session.createDataFrame(facts, "table_name string, position int, column_name string, type string")
    return listed.join(row_counts(tables), "table_name")


def sliced(source: JdbcSource, lower: int, upper: int, rows: int, per_slice: int = ROWS_PER_SLICE) -> JdbcSource:
    """``source`` read in slices of about ``per_slice`` rows between measured bounds."""
    partitions = max(1, -(-rows // per_slice))
    return replace(source, lower=lower, upper=max(upper, lower) + 1, partitions=partitions)


def with_measured_bounds(spark: SparkSession, source: JdbcSource, column: str, per_slice: int = ROWS_PER_SLICE) -> JdbcSource:
    """``source`` cut into slices of ``column``, whose least and greatest value the database is asked for."""
    whole = replace(source, partition_column=None)
    options = whole.options()
    options["query"] = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n FROM {options.pop('dbtable')}"
    r = spark.read.format("jdbc").options(**options).load().first()
    return whole if r["lo"] is None else sliced(replace(whole, partition_column=column), int(r["lo"]), int(r["hi"]), int(r["n"]), per_slice)


def load_folder(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return load_tables(spark, {n: f"{folder.rstrip('/')}/{n}.parquet" for n in names})


def normalise(frame: DataFrame) -> DataFrame:
    """Zoned times and dates become ``timestamp_ntz``, booleans become strings.

    Columns that already have the wanted type are passed through untouched, so filters on them
    still reach the Parquet scan.
    """
    out = []
    for f in frame.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            column = column.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            column = column.cast("string").alias(f.name)
        out.append(column)
    return frame.select(*out)


def list_columns(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) for every table by name and every column by position."""
    return [
        (name, f.name, f.dataType.simpleString())
        for name in sorted(tables)
        for f in tables[name].schema.fields
    ]


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table. Each branch is a metadata-cheap ``count(*)`` over no columns."""
    parts = [
        tables[name].agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        for name in sorted(tables)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def run_query(
    spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, args: Mapping | list | None = None
) -> DataFrame:
    """Parameterised SQL over the tables: ``{name}`` markers bind DataFrames, ``args`` values."""
    return spark.sql(sql, args=args, **tables)


def write_predictions(frame: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Predictions as a distributed write: Parquet by default, CSV with a header on request."""
    writer = frame.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def copy_to_database(tables: Mapping[str, DataFrame], targets: Mapping[str, JdbcSource]) -> None:
    """Create or replace each table in a database with parallel batched inserts."""
    for name, target in targets.items():
        options = copy_options(target)
        tables[name].write.format("jdbc").mode("overwrite").options(**options).save()


def copy_options(target: JdbcSource, batch_size: int = 10_000) -> dict[str, str]:
    opts = target.options()
    for read_only in ("partitionColumn", "lowerBound", "upperBound", "fetchsize"):
        opts.pop(read_only, None)
    return opts | {"batchsize": str(batch_size), "numPartitions": str(target.partitions)}
