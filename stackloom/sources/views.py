"""Profile-shaped views over the given tables, in Spark and as SQL text for the twins.

``samples`` are stack samples, ``records`` hourly records, ``symbols`` a symbol table with
gaps, ``ips`` addresses to resolve, ``exits`` process exits, ``switches`` switch-out and
switch-in events, ``ticks`` timer ticks per CPU.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.session import ship

#: Configuration that the views stand for.
FREQ, RECORD_INTERVAL, CPU_NUM = 49, 3600, 8

SQL = {
    "samples": """
select event_id as sample_id, 'h' || cast(user_id % 4 as varchar) as host, ts, cast(user_id as bigint) as pid, cast(event_id % 8 as bigint) as cpu,
 cast(user_id % 16 as bigint) as cgroup_id, event_type as comm, 'app' || cast(user_id % 10 as varchar) as group_comm,
 case when user_id % 5 = 0 then 'SYSTEM' else 'pod-' || cast(user_id % 7 as varchar) end as env,
 cast(json_extract_string(props, '$.k') as bigint) as k, cast(floor(value * 1000000) as bigint) as diff_ns, cast(1 as bigint) as cnt,
 list_concat(['main', 'dispatch_' || event_type, 'handler_' || cast(cast(json_extract_string(props, '$.k') as bigint) % 10 as varchar)],
   case when event_type = 'error' then ['sys_' || cast(cast(json_extract_string(props, '$.k') as bigint) % 3 as varchar) || '_[k]+' || cast(json_extract_string(props, '$.k') as varchar)] else [] end) as frames
from events""",
    "records": "select record_ts, dense_rank() over (order by record_ts) - 1 as record_idx from (select distinct date_trunc('hour', ts) as record_ts from events)",
    "symbols": "select cast(p_partkey as bigint) * 1000 as addr, min(p_name) as sym from part where p_partkey % 3 <> 0 group by p_partkey",
    "ips": "select distinct cast(l_partkey as bigint) * 1000 + cast(l_linenumber as bigint) * 37 as ip from lineitem",
    "exits": "select 'h' || cast(user_id % 4 as varchar) as host, cast(user_id as bigint) as pid, ts as exit_ts from events where event_type = 'signup'",
    "switches": "select event_id, cast(user_id as bigint) as tid, ts, case when event_type in ('view', 'click') then 'out' else 'in' end as kind from events",
    "ticks": "select event_id as tick_id, 'h' || cast(user_id % 4 as varchar) as host, cast(event_id % 8 as bigint) as cpu, epoch_us(ts) as ts_us, event_type = 'purchase' as throttled from events",
    "maps": "select cast(o_orderkey as bigint) as first, cast(o_orderkey + o_custkey % 50 as bigint) as last, cast(o_orderkey as bigint) as map_id from orders",
    "stores": "select cast(s_suppkey as bigint) as age, cast(floor(s_acctbal / 100) + 100 as bigint) as size_mb, s_name as name from supplier",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after a WITH clause of the named views."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names) + ("," if sql.lstrip().startswith(",") else "") + sql.lstrip().removeprefix(",")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = F.col("user_id").cast("long"), F.get_json_object("props", "$.k").cast("long")
    frames = F.concat(
        F.array(F.lit("main"), F.concat(F.lit("dispatch_"), "event_type"), F.concat(F.lit("handler_"), (k % 10).cast("string"))),
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("sys_"), (k % 3).cast("string"), F.lit("_[k]+"), k.cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        F.concat(F.lit("h"), (user % 4).cast("string")).alias("host"),
        "ts",
        user.alias("pid"),
        (F.col("event_id") % 8).cast("long").alias("cpu"),
        (user % 16).alias("cgroup_id"),
        F.col("event_type").alias("comm"),
        F.concat(F.lit("app"), (user % 10).cast("string")).alias("group_comm"),
        F.when(user % 5 == 0, "SYSTEM").otherwise(F.concat(F.lit("pod-"), (user % 7).cast("string"))).alias("env"),
        k.alias("k"),
        F.floor(F.col("value") * 1000000).cast("long").alias("diff_ns"),
        F.lit(1).cast("long").alias("cnt"),
        frames.alias("frames"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("record_ts")).distinct()
    return hours.withColumn("record_idx", (F.dense_rank().over(Window.orderBy("record_ts")) - 1).cast("long"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").groupBy((F.col("p_partkey").cast("long") * 1000).alias("addr")).agg(F.min("p_name").alias("sym"))


def ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey").cast("long") * 1000 + F.col("l_linenumber").cast("long") * 37).alias("ip")).distinct()


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("comm = 'signup'").select("host", "pid", F.col("ts").alias("exit_ts"))


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("tid"), "ts", F.when(F.col("event_type").isin("view", "click"), "out").otherwise("in").alias("kind"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.select(F.col("sample_id").alias("tick_id"), "host", "cpu", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (F.col("comm") == "purchase").alias("throttled"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("long")
    return o.select(key.alias("first"), (key + F.col("o_custkey") % 50).cast("long").alias("last"), key.alias("map_id"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("age"), (F.floor(F.col("s_acctbal") / 100) + 100).cast("long").alias("size_mb"), F.col("s_name").alias("name"))
