"""Catalog and result tables in a relational database, through Spark's JDBC source.

No database is available where this was written: the options and the statement text are tested, a connection is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_QUERY = "select event_id, event_name, city, category, base_ticket_price from events"
CITIES_QUERY = "select city_id, city_name from cities"


def jdbc_options(url: str, user: str, password: str, query: str | None = None, table: str | None = None,
                 **extra: str) -> dict[str, str]:
    """Options of a JDBC read of one query, or of a table (which may be split: partitionColumn and its bounds)."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    target = {"query": query} if query else {"dbtable": table}
    return {"url": url, "user": user, "password": password, **target, **extra}


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def create_statement(table: str) -> str:
    return (f'create table if not exists "{table}" (id varchar(200) primary key, "eventName" varchar(200), '
            f'value double precision not null)')


def upsert_statement(table: str, staging: str) -> str:
    return (f'insert into "{table}" (id, "eventName", value) select id, "eventName", value from "{staging}" '
            f'on conflict (id) do update set "eventName" = excluded."eventName", value = excluded.value')


def upsert_jdbc(rows: DataFrame, url: str, user: str, password: str, table: str, staging: str | None = None) -> None:
    """Last row per id into `table`: written to a staging table in parallel, merged and removed in one transaction."""
    staging = staging or f"{table}_staging"
    last = rows.groupBy("id").agg(F.max_by(F.struct("eventName", "value"), "pos").alias("r")).select("id", "r.*")
    last.write.format("jdbc").mode("overwrite").options(**jdbc_options(url, user, password, table=staging)).save()
    connection = rows.sparkSession._jvm.java.sql.DriverManager.getConnection(url, user, password)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in (create_statement(table), upsert_statement(table, staging), f'drop table "{staging}"'):
            statement.execute(text)
        connection.commit()
    finally:
        connection.close()
