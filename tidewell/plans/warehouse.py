"""The warehouse: source tables over the input, the yearly revenue table, and its checks."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = {"store": "R", "catalog": "N", "web": "A"}
#: Of each channel's table the columns of the day, the buyer and the amount, and the start of all its names.
SALES = {
    "store": ("ss_sold_date_sk", "ss_customer_sk", "ss_net_paid", "ss"),
    "catalog": ("cs_sold_date_sk", "cs_bill_customer_sk", "cs_net_paid", "cs"),
    "web": ("ws_sold_date_sk", "ws_bill_customer_sk", "ws_net_paid", "ws"),
}
REQUIRED = {
    "customer": ["c_customer_sk"],
    "date_dim": ["d_date_sk", "d_year"],
    **{f"{c}_sales": list(names[:3]) for c, names in SALES.items()},
}
MONEY = "decimal(38,2)"
#: Line items that a task joins, about: more of them make more tasks, not larger ones.
TASK_LINES = 500_000
SQL_FILE = Path(__file__).resolve().parents[1] / "sql" / "customer_revenue_yearly.sql"


class WarehouseError(ValueError):
    """A source or derived table that is not as declared."""


def _day_key(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))


def joined_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items with their orders' days and customers."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("paid"))
    orders, tasks = _orders(spark, sf_dir), -(-lines.count() // TASK_LINES)
    if tasks > 1:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def sources(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> dict[str, DataFrame]:
    """The source tables, named as in the catalog: the channels are the line items by return flag, with their orders' days and customers.

    ``sold``: ``joined_sales``, if it is stored already.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = _orders(spark, sf_dir)
    sold = joined_sales(spark, sf_dir) if sold is None else sold
    name = F.split("c_name", "#")
    days = orders.where("day is not null").select("day").distinct()

    def channel(c: str) -> DataFrame:
        date, buyer, paid, short = SALES[c]
        return sold.where(F.col("l_returnflag") == CHANNELS[c]).select(_day_key(F.col("day")).alias(date), F.col("o_custkey").alias(buyer), F.col("paid").alias(paid), F.col("l_orderkey").alias(f"{short}_order_number"), F.col("l_linenumber").alias(f"{short}_line_number"))

    return {
        "customer": read("customer").select(F.col("c_custkey").alias("c_customer_sk"), F.col("c_name").alias("c_customer_id"), F.get(name, F.lit(0)).alias("c_first_name"), F.get(name, F.lit(1)).alias("c_last_name")),
        "date_dim": days.select(_day_key(F.col("day")).alias("d_date_sk"), F.col("day").alias("d_date"), F.year("day").cast("long").alias("d_year")),
        **{f"{c}_sales": channel(c) for c in CHANNELS},
    }


def validate_sources(tables: dict[str, DataFrame]) -> None:
    for name, columns in REQUIRED.items():
        if name not in tables:
            raise WarehouseError(f"the table {name} is missing")
        if missing := sorted(set(columns) - set(tables[name].columns)):
            raise WarehouseError(f"{name} lacks {missing}")


def channel_union(tables: dict[str, DataFrame]) -> DataFrame:
    """(sales_channel, customer_sk, calendar_year, net_paid): all channels' rows that have a customer and a known day.

    The channels are put together before they meet the days, so the days are read and joined once; they are no more than a calendar has, so
    they may be broadcast.
    """
    parts = [tables[f"{c}_sales"].select(F.lit(c).alias("sales_channel"), F.col(buyer).alias("customer_sk"), F.col(day).alias("day"), F.col(paid).alias("net_paid")).where("customer_sk is not null") for c, (day, buyer, paid, _) in SALES.items()]
    days = tables["date_dim"].select("d_date_sk", F.col("d_year").cast("long").alias("calendar_year"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(F.broadcast(days), F.col("day") == F.col("d_date_sk")).select("sales_channel", "customer_sk", "calendar_year", "net_paid")


def revenue(tables: dict[str, DataFrame]) -> DataFrame:
    """Net paid of each customer and year by channel and in total: channels without sales are 0, a total of nulls is null."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("sales_channel") == c, F.col("net_paid"))), F.lit(0)).cast(MONEY).alias(f"{c}_net_paid")
    return channel_union(tables).groupBy("customer_sk", "calendar_year").agg(*map(of, CHANNELS), F.sum("net_paid").cast(MONEY).alias("total_net_paid"))


def revenue_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the channels share a fact table: it is scanned once, reduced to orders, then joined."""
    flag = {v: k for k, v in CHANNELS.items()}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag").isin(*flag)).select("l_orderkey", "l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("paid"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey is not null").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("calendar_year"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("l_returnflag") == CHANNELS[c], F.col("paid"))), F.lit(0)).cast(MONEY).alias(f"{c}_net_paid")
    return joined.groupBy(F.col("o_custkey").alias("customer_sk"), "calendar_year").agg(*map(of, CHANNELS), F.sum("paid").cast(MONEY).alias("total_net_paid"))


def unreconciled(table: DataFrame) -> DataFrame:
    """The rows whose channels don't add up to the total."""
    return table.where("store_net_paid + catalog_net_paid + web_net_paid <> total_net_paid")


def validate_revenue(table: DataFrame) -> int:
    """The number of rows; an error if columns lack, no row is there, or a total is not the sum of its channels."""
    wanted = {"customer_sk", "calendar_year", "store_net_paid", "catalog_net_paid", "web_net_paid", "total_net_paid"}
    if missing := sorted(wanted - set(table.columns)):
        raise WarehouseError(f"the revenue table lacks {missing}")
    n, bad = table.agg(F.count("*"), F.count(F.when(F.expr("store_net_paid + catalog_net_paid + web_net_paid <> total_net_paid"), 1))).first()
    if not n:
        raise WarehouseError("the revenue table is empty")
    if bad:
        raise WarehouseError(f"{bad} totals are not the sum of their channels")
    return n


def top_customers(table: DataFrame, customers: DataFrame, year: int, n: int) -> DataFrame:
    best = table.where(F.col("calendar_year") == year).join(customers, F.col("customer_sk") == F.col("c_customer_sk"))
    return best.select("customer_sk", "c_customer_id", "c_first_name", "c_last_name", "total_net_paid").orderBy(F.desc_nulls_last("total_net_paid"), "customer_sk").limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.union(one)
    return out


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """The number of rows, and a digest of what they hold that does not depend on their order."""
    n, total = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return n, hashlib.sha256(f"{df.schema.simpleString()} {n} {total}".encode()).hexdigest()


def _save(df: DataFrame, view: str, place: str, partition: str | None) -> DataFrame:
    """Save a table at ``place``, partitioned if so told, and point the view to it. The rows of a partition go to several files, so that a large one is no task's alone."""
    spark = df.sparkSession
    table = f"{view}__{uuid.uuid4().hex[:12]}"
    rest = [c for c in df.columns if c != partition]
    writer = df.repartition(F.col(partition), F.pmod(F.xxhash64(*rest), F.lit(16))).write.partitionBy(partition) if partition else df.write
    writer.option("path", place).saveAsTable(table)
    if partition:
        validate_revenue(spark.table(table))
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ('stored' = '{table}') AS SELECT {', '.join(df.columns)} FROM {table}")
    db, name = view.split(".")
    for t in spark.catalog.listTables(db, f"{name}__*"):  # what the view named before; its files stay until the build after the next
        if f"{db}.{t.name}" != table:
            spark.sql(f"DROP TABLE IF EXISTS {db}.{t.name}")
    return spark.table(view)


def _prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the newest folders in ``folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in sorted(fs.listStatus(path), key=lambda f: f.getModificationTime())[: -keep or None]:
        fs.delete(old.getPath(), True)


def build_warehouse(spark: SparkSession, sf_dir: str, path: str, manifest: str | None = None, sql_file: Path | str = SQL_FILE) -> dict:
    """Write the sources and the revenue table under ``path``, check them, register them as raw.* and analytics.*; the manifest's content.

    Line items and orders are joined once, and the channels read what that has stored. Every table is saved in a folder of its own, the
    revenue by year, and its view then points there, so a reader sees the old table or the new one, and a build that fails leaves the
    revenue table as it was. Of each table the last two folders are kept. ``manifest`` names a file of the driver's to write the manifest to.
    """
    sql = Path(sql_file).read_text(encoding="utf-8")
    validate_sources(sources(spark, sf_dir))
    staging, joined = f"{path}/staging/{uuid.uuid4().hex[:12]}", joined_sales(spark, sf_dir)
    joined.write.partitionBy("l_returnflag").parquet(staging)
    tables = sources(spark, sf_dir, spark.read.schema(joined.schema).parquet(staging))
    for db in ("raw", "analytics"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")

    def put(db: str, name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        kept = _save(df, f"{db}.{name}", f"{path}/{db}/{name}/{uuid.uuid4().hex[:12]}", partition)
        _prune(spark, f"{path}/{db}/{name}")
        return kept

    kept = {f"raw.{name}": put("raw", name, df) for name, df in tables.items()}
    kept["analytics.customer_revenue_yearly"] = put("analytics", "customer_revenue_yearly", spark.sql(sql), "calendar_year")
    _prune(spark, f"{path}/staging", 0)
    prints = {name: fingerprint(df) for name, df in kept.items()}
    told = {
        "source": sf_dir,
        "warehouse": path,
        "spark_version": spark.version,
        "generated_at_utc": datetime.now(UTC).isoformat(),
        "table_row_counts": {name: n for name, (n, _) in prints.items()},
        "table_sha256": {name: h for name, (_, h) in prints.items()},
        "transformation_sql_file": str(sql_file),
        "transformation_sql_sha256": hashlib.sha256(sql.encode()).hexdigest(),
    }
    if manifest:
        Path(manifest).write_text(json.dumps(told, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return told


def refresh_years(spark: SparkSession, sf_dir: str, years: list[int], view: str = "analytics.customer_revenue_yearly") -> int:
    """Compute some years of the revenue table anew and overwrite these partitions only; the number of rows they have now."""
    store = spark.sql(f"SHOW TBLPROPERTIES {view} ('stored')").first().value
    fresh = revenue_one_scan(spark, sf_dir).where(F.col("calendar_year").isin(list(years)))
    rows = fresh.select(*spark.table(store).columns)
    found = {r.calendar_year: r for r in rows.groupBy("calendar_year").agg(F.count("*").alias("n"), F.count(F.when(F.expr("store_net_paid + catalog_net_paid + web_net_paid <> total_net_paid"), 1)).alias("bad")).collect()}
    if bad := sum(r.bad for r in found.values()):
        raise WarehouseError(f"{bad} totals are not the sum of their channels")
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {store}").where("col_name = 'Location'").first().data_type
    rows.repartition("calendar_year", F.pmod(F.xxhash64("customer_sk"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calendar_year").parquet(place)
    spark.catalog.recoverPartitions(store)  # of years that are new
    for year in set(years) - set(found):  # nothing is left of these
        spark.sql(f"ALTER TABLE {store} DROP IF EXISTS PARTITION (calendar_year = {int(year)})")
    spark.catalog.refreshTable(store)
    return sum(r.n for r in found.values())
