"""One SQL source for every DBMS with a JDBC driver on the class path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.tables import read_jdbc

#: Driver class, URL format and usual port of each kind of DBMS.
KINDS = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}", 0),
    "duckdb": ("org.duckdb.DuckDBDriver", "jdbc:duckdb:{database}", 0),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}", 8123),
    "hive": ("org.apache.hive.jdbc.HiveDriver", "jdbc:hive2://{host}:{port}/{database}", 10000),
    "presto": ("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://{host}:{port}/{database}", 8080),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}", 443),
    "bigquery": ("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://{host}:{port};ProjectId={database}", 443),
    "derby": ("org.apache.derby.iapi.jdbc.AutoloadedDriver", "jdbc:derby:{database}", 0),
}


@dataclass(frozen=True)
class Database:
    """A DBMS whose queries become DataFrames; filters and columns put on them are pushed down where the dialect allows."""

    spark: SparkSession
    kind: str
    database: str
    host: str = "localhost"
    port: int | None = None
    options: tuple[tuple[str, str], ...] = ()

    def url(self) -> str:
        _, form, port = KINDS[self.kind]
        return form.format(host=self.host, port=self.port or port, database=self.database)

    def run_sql(self, sql: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
        return read_jdbc(self.spark, self.url(), sql, partition_column, bounds, partitions, driver=KINDS[self.kind][0], **dict(self.options))

    def write(self, df: DataFrame, table: str, mode: str = "append", batch: int = 10_000) -> None:
        df.write.format("jdbc").option("url", self.url()).option("dbtable", table).option("driver", KINDS[self.kind][0]).option("batchsize", batch).options(**dict(self.options)).mode(mode).save()
