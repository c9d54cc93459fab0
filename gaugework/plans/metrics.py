"""Metric operators on events: host = user, device = event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.times import clock_text
from gaugework.lineage import scratch_path
from gaugework.operators import metrics
from gaugework.plans.registry import query
from gaugework.sources.feeds import DEVICE_COLUMN, feed_columns, read_metric_feed, write_metric_feed
from gaugework.sources.metric_names import DISK_METRICS, GENERAL_METRICS, NETWORK_METRICS, PLAIN_COLUMNS, plain_name
from gaugework.sources.tables import load

DAY = 86400


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        F.col("user_id").alias("host"), "ts", F.col("event_type").alias("device"), "value"
    )


#: The event types that stand for each of the three feeds; every event is in one of them.
FEEDS = {"general": ["view", "signup"], "disk": ["click", "error"], "network": ["purchase"]}


def feed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    one = samples(spark, sf).where(F.col("device").isin(FEEDS[name])).select("host", "ts", F.col("value").alias(name))
    return metrics.metric_resample(one, DAY)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """The three feeds joined by user and day."""
    return metrics.metric_join(*[feed(spark, sf, name) for name in FEEDS])


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", clock_text(F.col("ts")))


def feed_sql(name: str) -> str:
    return f"""(SELECT user_id AS host, time_bucket(INTERVAL 1 DAY, ts) AS ts, arg_min(value, ts) AS value
      FROM events WHERE event_type IN ({", ".join(f"'{t}'" for t in FEEDS[name])}) GROUP BY 1, 2)"""


DAILY_SQL = f"""
SELECT g.host, g.ts, g.value AS general, d.value AS disk, n.value AS network
FROM {feed_sql("general")} g JOIN {feed_sql("disk")} d USING (host, ts) JOIN {feed_sql("network")} n USING (host, ts)
"""


@query(
    "metric_prune",
    "SELECT user_id AS host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS device, value FROM events",
)
def metric_prune(spark, sf):
    raw = load(spark, sf, "events").select(
        F.col("user_id").alias("host"),
        F.lit(5).alias("interval"),
        "ts",
        F.lit("-1").alias("CPU"),
        F.col("event_id").alias("INTR"),
        F.col("event_type").alias("device"),
        "value",
    )
    return shown(metrics.metric_prune(raw))


@query(
    "metric_resample",
    """
SELECT user_id AS host, event_type AS device, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS ts,
       arg_min(value, ts) AS value
FROM events GROUP BY 1, 2, 3
""",
)
def metric_resample(spark, sf):
    return shown(metrics.metric_resample(samples(spark, sf), 3600, ["host", "device"]))


@query(
    "metric_join",
    f"SELECT host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, general, disk, network FROM ({DAILY_SQL})",
)
def metric_join(spark, sf):
    return shown(daily(spark, sf))


@query(
    "metric_device_rollup",
    """
SELECT user_id AS host, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS ts,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS rate, max(value) AS util,
       count(DISTINCT event_type) AS devices
FROM events GROUP BY 1, 2
""",
)
def metric_device_rollup(spark, sf):
    bucketed = samples(spark, sf).withColumn("ts", F.window("ts", f"{DAY} seconds")["start"])
    rolled = metrics.metric_device_rollup(
        bucketed,
        [
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("rate"),
            F.max("value").alias("util"),
            F.countDistinct("device").alias("devices"),
        ],
    )
    return shown(rolled)


DEVICE = {"general": "CPU", **DEVICE_COLUMN}
METRICS = {
    kind: [plain_name(m) for m in names]
    for kind, names in (("general", GENERAL_METRICS), ("disk", DISK_METRICS), ("network", NETWORK_METRICS))
}


def _combined_sql(name: str, value: str) -> str:
    if "pct" in name:
        return f"max({value})"
    return f"{'avg' if name.endswith(('avgrq_sz', 'avgqu_sz', 'await', 'svctm')) else 'sum'}({value})"


def device_feed_sql(kind: str) -> str:
    """The first sample of each user, device and day; devices rolled up but for the feed that has none."""
    types = ", ".join(f"'{t}'" for t in FEEDS[kind])
    device = "" if kind == "general" else ", event_type"
    first = f"""SELECT user_id AS host, time_bucket(INTERVAL 1 DAY, ts) AS ts, arg_min(floor(value), ts) AS v
      FROM events WHERE event_type IN ({types}) GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts){device}"""
    if kind == "general":
        return f"(SELECT host, ts, {', '.join(f'v + {i} AS {m}' for i, m in enumerate(METRICS[kind]))} FROM ({first}))"
    columns = ", ".join(f"{_combined_sql(m, f'v + {i}')} AS {m}" for i, m in enumerate(METRICS[kind]))
    return f"(SELECT host, ts, {columns} FROM ({first}) GROUP BY host, ts)"


TABLE_SQL = f"""
SELECT CAST(g.host AS VARCHAR) AS host, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS {PLAIN_COLUMNS[0]},
       {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in PLAIN_COLUMNS[1:])}
FROM {device_feed_sql("general")} g JOIN {device_feed_sql("disk")} d USING (host, ts)
     JOIN {device_feed_sql("network")} n USING (host, ts)
"""
WIDE_SQL = f"SELECT * EXCLUDE (host) FROM ({TABLE_SQL})"


def exported(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A feed in the columns of its export: event types are the devices, the n-th metric is the whole value + n."""
    value = F.floor("value").cast("double")
    metric = {m: (value + F.lit(float(i))).alias(m) for i, m in enumerate(METRICS[kind])}
    identity = {
        "host": F.col("host").cast("string"),
        "interval": F.lit(DAY).alias("interval"),
        "ts": F.col("ts"),
        "CPU": F.lit("-1").alias("CPU"),
        "INTR": F.lit("sum").alias("INTR"),
        DEVICE_COLUMN.get(kind, "CPU"): (F.lit("-1") if kind == "general" else F.col("device")).alias(DEVICE[kind]),
    }
    rows = samples(spark, sf).where(F.col("device").isin(FEEDS[kind]))
    return rows.select(*[(metric | identity)[c] for c in feed_columns(kind)])


def joined(feeds: dict[str, DataFrame]) -> DataFrame:
    """The metric table of the three feeds by user and day, each column from its own feed."""
    daily = [
        metrics.metric_resample(metrics.metric_prune(df), DAY, ["host"] if kind == "general" else ["host", DEVICE[kind]])
        for kind, df in feeds.items()
    ]
    return shown(metrics.metric_table(*daily))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The metric table under the names of its operators, without the host."""
    return joined({kind: exported(spark, sf, kind) for kind in FEEDS}).drop("host")


@query("metric_table", TABLE_SQL)
def metric_table(spark, sf):
    """From the three exported files to the named table."""
    back = {}
    for kind in FEEDS:
        path = scratch_path(spark, f"export-{kind}")
        write_metric_feed(exported(spark, sf, kind), path, kind)
        back[kind] = read_metric_feed(spark, path, kind)
    return metrics.metric_rename(joined(back), ["host", *PLAIN_COLUMNS])


@query("metric_rename", WIDE_SQL)
def metric_rename(spark, sf):
    return metrics.metric_rename(wide(spark, sf), PLAIN_COLUMNS)


@query(
    "metric_groups",
    f"""
SELECT "timestamp", split_part(metric, '_', 1) || '_' AS "group", metric, value
FROM (UNPIVOT ({WIDE_SQL}) ON COLUMNS(lambda c: c LIKE 'disk\\_%' ESCAPE '\\' OR c LIKE 'cpu\\_%' ESCAPE '\\')
      INTO NAME metric VALUE value)
""",
)
def metric_groups(spark, sf):
    table = metrics.metric_rename(wide(spark, sf), PLAIN_COLUMNS)
    return metrics.metric_long(table, ["timestamp"], ["cpu_", "disk_"])


@query(
    "node_number",
    """
SELECT event_id, user_id AS host, dense_rank() OVER (ORDER BY user_id) AS node_no FROM events
""",
)
def node_number(spark, sf):
    events = load(spark, sf, "events").select("event_id", F.col("user_id").alias("host"))
    return metrics.with_node_number(events)


@query(
    "run_metrics_union",
    """
SELECT event_id, user_id AS host, CASE WHEN event_type IN ('view', 'click') THEN value END AS disk,
       CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS network
FROM events
""",
)
def run_metrics_union(spark, sf):
    events = load(spark, sf, "events")
    is_disk = F.col("event_type").isin("view", "click")
    keys = ["event_id", F.col("user_id").alias("host")]
    disk = events.where(is_disk).select(*keys, F.col("value").alias("disk"))
    network = events.where(~is_disk).select(*keys, F.col("value").alias("network"))
    return metrics.run_metrics_union([disk, network])
