"""The engine's inputs, derived from the given tables.

Every row of `events` is a sale or an expense (type `error`) of the event `E<user_id>`; `part` is the event catalog.
Some records have no key and some carry a renamed event, so that the rules for both show in the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstile.functions.scalars import TICKET_RATE
from turnstile.operators.lookup import is_small
from turnstile.session import materialise
from turnstile.sources import topics


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:  # infer once: every inference is a job of its own
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('E', p_partkey) as event_id", "p_name as event_name", "p_type as category",
        "cast(p_retailprice as decimal(10,2)) as base_ticket_price")


_few_events: dict[str, bool] = {}


def _events_to_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`_named_events` to be joined with records: by shuffle, unless they are counted to be few."""
    events = _named_events(spark, sf_dir)
    if sf_dir not in _few_events:
        _few_events[sf_dir] = is_small(events)
    return events if _few_events[sf_dir] else events.hint("merge")


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""select event_id, event_name, n_name as city, category, base_ticket_price
                        from {events} join {nation} on p_partkey % 25 = n_nationkey""",
                     events=_named_events(spark, sf_dir), nation=table(spark, sf_dir, "nation"))


def city_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey as city_id", "n_name as city_name")


_RECORD = ["case when event_id % 50 <> 17 then concat('E', user_id) end as key", "cast(ts as timestamp) as ts",
           "event_id as seq", "concat('E', user_id) as event_id"]


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales before pricing: what was bought, not yet what it costs."""
    return table(spark, sf_dir, "events").where("event_type <> 'error'").selectExpr(
        *_RECORD, "concat('S', event_id) as sale_id",
        "case event_id % 3 when 1 then 'VIP' when 2 then 'STUDENT' else 'NORMAL' end as ticket_type",
        "cast(3 + event_id % 8 as int) as quantity")


def raw_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        *_RECORD, "concat('X', event_id) as expense_id",
        """case event_id % 5 when 0 then 'venue' when 1 then 'security' when 2 then 'marketing' when 3 then 'staff'
           else 'equipment' end as expense_type""",
        "cast((50 + floor(value)) * 100 as double) as cost")


def ticket_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced sales, each in a city of its own (an event sells in many)."""
    return spark.sql(f"""
        select key, ts, seq, sale_id, event_id,
               if(seq % 4 = 0, concat(event_name, ' (renamed)'), event_name) as event_name, n_name as city, category,
               ticket_type, cast(base_ticket_price as double) * {TICKET_RATE} as ticket_price, quantity
        from {{raw}} join {{events}} using (event_id) join {{nation}} on seq % 25 = n_nationkey""",
                     raw=raw_sales(spark, sf_dir), events=_events_to_join(spark, sf_dir),
                     nation=table(spark, sf_dir, "nation"))


def barred_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ticket_sales` where every third record's event id goes on behind a bar."""
    return ticket_sales(spark, sf_dir).withColumn("event_id", F.expr("if(seq % 3 = 0, concat(event_id, '|', seq % 2), event_id)"))


def event_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""select key, ts, seq, expense_id, event_id, event_name, expense_type, cost
                        from {raw} join {events} using (event_id)""",
                     raw=raw_expenses(spark, sf_dir), events=_events_to_join(spark, sf_dir))


_LINE = """concat('E', l_suppkey) as key, cast(l_shipdate as timestamp) as ts, l_orderkey * 8 + l_linenumber as seq,
           concat('E', l_suppkey) as event_id, s_name as event_name"""


def bulk_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled order line as a sale: the large input. Many times tie, and `seq` settles their order."""
    names = ("lineitem", "part", "supplier", "orders", "customer", "nation")
    return spark.sql(f"""
        select {_LINE}, n_name as city,
               p_retailprice * case l_returnflag when 'A' then 1.8D when 'R' then 0.7D else 1.0D end as ticket_price,
               cast(l_quantity as int) as quantity
        from {{lineitem}} join {{part}} on p_partkey = l_partkey join {{supplier}} on s_suppkey = l_suppkey
        join {{orders}} on o_orderkey = l_orderkey join {{customer}} on c_custkey = o_custkey
        join {{nation}} on n_nationkey = c_nationkey
        where l_linestatus = 'F'""", **{name: table(spark, sf_dir, name) for name in names})


def bulk_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every open order line as an expense."""
    return spark.sql(f"""select {_LINE}, l_extendedprice * l_discount as cost
                         from {{lineitem}} join {{supplier}} on s_suppkey = l_suppkey where l_linestatus = 'O'""",
                     lineitem=table(spark, sf_dir, "lineitem"), supplier=table(spark, sf_dir, "supplier"))


def sales_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ticket_sales` as a written topic; ten of every sixteen records are altered, most of them beyond reading."""
    text, kind = F.col("value"), F.col("offset") % 16
    price, quantity = r'"ticketPrice":([^,}]+)', r'"quantity":([^,}]+)'
    altered = (F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, "null").when(kind == 3, "{bad")
               .when(kind == 4, F.regexp_replace(text, price, '"ticketPrice":"abc"'))
               .when(kind == 5, F.regexp_replace(text, quantity, '"quantity":3.5'))
               .when(kind == 6, F.regexp_replace(text, price + ",", ""))
               .when(kind == 7, F.regexp_replace(text, price, r'"ticketPrice":"$1"'))
               .when(kind == 8, F.expr("left(value, length(value) - 1)"))
               .when(kind == 9, F.concat(text, F.lit(" {}"))).otherwise(text))
    records = topics.encode_sales(ticket_sales(spark, sf_dir), partitions=1).withColumn("value", altered)
    return materialise(records, "topic")


def untimed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ticket_sales` as a topic; some records have no time, or one before 1970."""
    kind = F.col("offset") % 16
    moved = F.when(kind == 1, F.lit("1969-12-31 23:59:59").cast("timestamp")).when(kind != 0, F.col("timestamp"))
    return topics.encode_sales(ticket_sales(spark, sf_dir), partitions=1).withColumn("timestamp", moved)


#: Every seventh record is delayed: its time lies 23 h 50 min to 24 h 9 min before, or some days.
_DELAYED = """case when seq % 7 = 3 then ts - make_dt_interval(if(seq % 5 = 0, seq % 4, 0), 23, 50 + seq % 20) else ts end"""


def delayed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ticket_sales` that arrive in the order of `seq`, some of them late."""
    return ticket_sales(spark, sf_dir).withColumn("ts", F.expr(_DELAYED))


def delayed_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_expenses(spark, sf_dir).withColumn("ts", F.expr(_DELAYED))


def catalog_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as three reloads found it, each later one dearer and without some events; a fourth reload, between them, found none."""
    reloads = [("2024-01-03 00:00:00", 0), ("2024-01-10 12:00:00", None), ("2024-01-12 00:00:00", 1), ("2024-01-20 06:30:00", 2)]
    events = event_catalog(spark, sf_dir)
    copies = [events.where(f"{n is not None} and (cast(substr(event_id, 2) as long) + {n or 0}) % 9 <> 0").selectExpr(
        f"timestamp '{taken}' as snapshot_ts", "event_id", f"concat(event_name, ' #{n}') as event_name", "city", "category",
        f"cast(if(cast(substr(event_id, 2) as long) % 3 = 0, base_ticket_price, base_ticket_price + 10 * {n or 0}) as decimal(10,2)) as base_ticket_price")
        for taken, n in reloads]
    out = copies[0]
    for copy in copies[1:]:
        out = out.unionByName(copy)
    return out


def city_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for new cities: some blank, some too long, some known, some asked for twice."""
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        n.alias("seq"),
        F.when(n % 7 == 0, "  ").when(n % 7 == 1, F.concat(F.lit("NATION_"), "c_nationkey"))
        .when(n % 7 == 2, F.repeat(F.lit("x"), 101)).otherwise(F.concat(F.lit("City "), F.floor(n / 3)))
        .alias("city_name"))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    kind = n % 13
    ident = F.concat(F.lit("E"), F.floor(n / 2) * 4)
    return table(spark, sf_dir, "customer").select(
        n.alias("seq"), F.when(kind == 4, F.rpad(ident, 21, "0")).otherwise(ident).alias("event_id"),
        F.when(kind == 0, " ").otherwise(F.col("c_name")).alias("event_name"),
        F.when(kind != 1, F.concat(F.lit("City "), "c_nationkey")).alias("city"),
        F.col("c_mktsegment").alias("category"),
        F.when(kind == 2, "abc").when(kind == 3, "100000000").when(kind == 5, "12.345").when(kind == 6, "")
        .otherwise(F.concat((10 + n % 50).cast("string"), F.lit(".5"))).alias("base_ticket_price"))
