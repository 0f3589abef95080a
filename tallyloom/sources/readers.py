"""Typed scans. Schemas are given where they are known; nothing is inferred by an extra pass unless asked for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source type names -> Spark SQL types.
TYPES = {
    "string": "string", "integer": "bigint", "int64": "bigint", "real": "double", "double": "double", "number": "double", "decimal": "decimal(38,10)", "currency": "decimal(19,4)", "percentage": "double",
    "boolean": "boolean", "date": "date", "datetime": "timestamp", "time": "string", "spatial": "string", "binary": "binary",
}


def schema(columns: dict[str, str]) -> str:
    """A schema from source type names."""
    return ", ".join(f"`{c}` {TYPES[t]}" for c, t in columns.items())


def csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, delimiter: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", delimiter).option("encoding", encoding)
    return (reader.schema(schema(columns)) if columns else reader).csv(path)


def json(spark: SparkSession, path: str, columns: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """A list of records, or records one to a line."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema(columns)) if columns else reader).json(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: its properties, and the geometry as JSON text."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


def xml(spark: SparkSession, path: str, row_tag: str, columns: dict[str, str] | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema(columns)) if columns else reader).load(path)


def wildcard(spark: SparkSession, folder: str, extension: str = ".csv", delimiter: str = ",", columns: dict[str, str] | None = None) -> DataFrame:
    """All files of a folder, with the name of each row's file."""
    return csv(spark, f"{folder}/*{extension}", columns, delimiter).withColumn("file_name", F.col("_metadata.file_name"))


def stored(spark: SparkSession, url: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Files in an object store by their URL (abfss, s3a, gs, ...)."""
    return spark.read.options(**options).format(kind).load(url)


#: JDBC URLs by database.
JDBC = {
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}", "azuresql": "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", "synapse": "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}", "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}", "redshift": "jdbc:redshift://{host}:{port}/{database}",
    "teradata": "jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", "saphana": "jdbc:sap://{host}:{port}/?databaseName={database}", "vertica": "jdbc:vertica://{host}:{port}/{database}", "impala": "jdbc:impala://{host}:{port}/{database}",
    "presto": "jdbc:presto://{host}:{port}/{database}", "trino": "jdbc:trino://{host}:{port}/{database}", "athena": "jdbc:athena://AwsRegion={host};Database={database}", "db2": "jdbc:db2://{host}:{port}/{database}", "derby": "jdbc:derby:{database}",
}


def jdbc_options(kind: str, host: str, database: str, table: str | None = None, query: str | None = None, port: int = 0, split: tuple[str, int, int, int] | None = None, **more: str) -> dict[str, str]:
    """Options of a JDBC scan; split = (column, low, high, partitions) reads in parallel."""
    out = {"url": JDBC[kind].format(host=host, port=port, database=database), **more}
    out |= {"query": query} if query else {"dbtable": table}
    if split:
        out |= {"partitionColumn": split[0], "lowerBound": str(split[1]), "upperBound": str(split[2]), "numPartitions": str(split[3])}
    return out


def jdbc(spark: SparkSession, kind: str, **where) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, **where)).load()


#: Connectors of warehouses and document stores, by Spark format name, and the option that names the table.
CONNECTORS = {"snowflake": ("snowflake", "dbtable"), "bigquery": ("bigquery", "table"), "mongodb": ("mongodb", "collection"), "cosmosdb": ("cosmos.oltp", "spark.cosmos.container")}


def connector_options(kind: str, table: str, **options: str) -> tuple[str, dict[str, str]]:
    name, key = CONNECTORS[kind]
    return name, {key: table, **options}


def connector(spark: SparkSession, kind: str, table: str, **options: str) -> DataFrame:
    """Needs the connector's package on the cluster."""
    name, given = connector_options(kind, table, **options)
    return spark.read.format(name).options(**given).load()


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """A table of any catalog the session knows, or a published dataset by its view name."""
    return spark.table(name)


def custom_sql(spark: SparkSession, sql: str, parameters: dict | None = None) -> DataFrame:
    """SQL over the session's views with named parameters (:name)."""
    return spark.sql(sql, args=parameters or {})


def extract(spark: SparkSession, path: str) -> DataFrame:
    """A columnar extract."""
    return spark.read.parquet(path)


def inline(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(rows, schema(columns))


def guarded(spark: SparkSession, read, columns: dict[str, str]) -> DataFrame:
    """What read() gives, or an empty table of these columns if the source cannot be found."""
    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema(columns))


def permissive(spark: SparkSession, path: str, columns: dict[str, str], kind: str = "csv") -> DataFrame:
    """Records that do not fit keep their text in _corrupt_record."""
    reader = spark.read.schema(schema(columns) + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast to the declared types; what does not fit is null."""
    return df.select(*[F.col(c).try_cast(TYPES[t]).alias(c) for c, t in columns.items()])


def publish(df: DataFrame, name: str) -> None:
    """Make a dataset available to catalog() in this session."""
    df.createOrReplaceTempView(name)


def spark_type(name: str) -> T.DataType:
    return T._parse_datatype_string(TYPES[name])
