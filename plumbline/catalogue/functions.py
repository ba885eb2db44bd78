"""Sources, introspection and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import EVENTS_AS_OF, TABLES, Tables, at, query, sql_at
from plumbline.functions import time
from plumbline.functions.lineage import fresh_dir
from plumbline.functions.normalise import normalise
from plumbline.functions.text import row_text, value_text
from plumbline.sources import Connection, open_connections, parquet_connection, static_connection
from plumbline.sources.introspect import describe_columns, grouped_by_table, reachable, row_counts, sample_table
from plumbline.sources.pages import read_pages, write_pages

NOW = sql_at(EVENTS_AS_OF)

_BY_PRIORITY = """
    SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS filled
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_orderpriority"""


@query("src_query", _BY_PRIORITY)
def src_query(t: Tables) -> DataFrame:
    live, _ = open_connections(t.spark, [parquet_connection("shop", t.root, ["orders"])])
    return live["shop"].sql(_BY_PRIORITY.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


@query(
    "src_static",
    """SELECT s.label, count(o.o_orderkey) AS n FROM (VALUES ('O', 'open'), ('F', 'filled'), ('X', 'unknown')) s(code, label)
       LEFT JOIN orders o ON o.o_orderstatus = s.code GROUP BY s.label""",
)
def src_static(t: Tables) -> DataFrame:
    names = static_connection("codes", {"status": ([("O", "open"), ("F", "filled"), ("X", "unknown")], "code string, label string")})
    orders = parquet_connection("shop", t.root, ["orders"])
    both = Connection("both", lambda spark: {**names.load(spark), **orders.load(spark)})
    live, _ = open_connections(t.spark, [both])
    return live["both"].sql("""
        SELECT s.label, coalesce(o.n, 0) AS n FROM status s
        LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) o ON o.o_orderstatus = s.code""")


def _rfc3339(column: str) -> str:
    micros = f"strftime({column}, '%f')"
    return f"""strftime({column}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = '000000' THEN ''
        WHEN {micros} LIKE '%000' THEN '.' || left({micros}, 3) ELSE '.' || {micros} END || '+00:00'"""


@query(
    "src_normalise",
    f"""SELECT event_id, {_rfc3339('ts')} AS ts, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day, (value::DECIMAL(10, 2) * 3)::DOUBLE AS price
        FROM events""",
)
def src_normalise(t: Tables) -> DataFrame:
    typed = t.events.select(
        F.col("event_id").cast("int"), "ts", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"),
        (F.col("value").cast("decimal(10,2)") * 3).alias("price"),
    )
    return normalise(typed)


_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"""


@query(
    "schema_describe",
    f"""SELECT c.table_name, c.described, n.n_rows FROM
            (SELECT table_name, string_agg(column_name || ':' || {_TYPES}, ',' ORDER BY ordinal_position) AS described
             FROM information_schema.columns GROUP BY table_name) c
            JOIN ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)}) n USING (table_name)""",
)
def schema_describe(t: Tables) -> DataFrame:
    frames = {name: getattr(t, name) for name in TABLES}
    per_table = grouped_by_table(describe_columns(t.spark, frames))
    text = F.array_join(F.transform("columns", lambda c: F.concat(c.getField("name"), F.lit(":"), c.getField("type"))), ",")
    return per_table.join(row_counts(t.spark, frames), "table_name").select("table_name", text.alias("described"), "n_rows")


@query("table_sample", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def table_sample(t: Tables) -> DataFrame:
    priced = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", (-F.col("o_totalprice")).alias("_rank"))
    return sample_table(priced, 25, ["_rank", "o_orderkey"]).drop("_rank")


@query(
    "source_reachable",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, 1 AS ok, true AS clean, count(*) AS n_rows FROM {t}" for t in TABLES)
    + " UNION ALL SELECT 'dead', 0, false, CAST(NULL AS BIGINT)",
)
def source_reachable(t: Tables) -> DataFrame:
    """Every table and one that is not there, with the rows of those that are."""
    opened = {name: (lambda name=name: getattr(t, name)) for name in TABLES}
    probed = reachable(t.spark, {**opened, "dead": lambda: t.spark.read.parquet(f"{t.root}/dead.parquet")})
    counts = row_counts(t.spark, {name: getattr(t, name) for name in TABLES})
    return probed.join(counts, "table_name", "left").select("table_name", "ok", F.col("error").isNull().alias("clean"), "n_rows")


_AMOUNTS = """SELECT l_quantity / 4 || CASE l_returnflag WHEN 'A' THEN 's' WHEN 'N' THEN 'h' ELSE CASE l_linestatus WHEN 'O' THEN 'd' ELSE 'w' END END AS span
              FROM lineitem"""


@query(
    "fn_duration",
    f"""SELECT span, count(*) AS n, round(try_cast(left(span, -1) AS DOUBLE) *
               CASE right(span, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END, 3) AS seconds
        FROM ({_AMOUNTS}) GROUP BY span""",
)
def fn_duration(t: Tables) -> DataFrame:
    unit = (
        F.when(F.col("l_returnflag") == "A", "s").when(F.col("l_returnflag") == "N", "h")
        .when(F.col("l_linestatus") == "O", "d").otherwise("w")
    )
    span = F.concat((F.col("l_quantity") / 4).cast("string"), unit)
    counted = t.lineitem.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("seconds", F.round(time.duration_seconds(F.col("span")), 3))


@query(
    "fn_interval_secs",
    """SELECT span, count(*) AS n, CASE WHEN regexp_full_match(span, '[0-9]+[smhd]') THEN left(span, -1)::BIGINT *
              CASE right(span, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END END AS seconds
       FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN p_size || 'm' WHEN 'SMALL' THEN p_size || 'd' WHEN 'LARGE' THEN p_size || '.5m'
                    ELSE p_size || 'x' END AS span FROM part) GROUP BY span""",
)
def fn_interval_secs(t: Tables) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    tail = F.when(kind == "ECONOMY", "m").when(kind == "SMALL", "d").when(kind == "LARGE", ".5m").otherwise("x")
    counted = t.part.groupBy(F.concat(size, tail).alias("span")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("seconds", time.interval_seconds(F.col("span")))


@query(
    "fn_age",
    f"""SELECT event_id, (epoch_us({NOW}) - epoch_us(ts)) / 1000000 AS age, epoch({NOW}) - floor(epoch(ts)) AS age_of_number FROM events""",
)
def fn_age(t: Tables) -> DataFrame:
    now = at(EVENTS_AS_OF)
    whole = F.floor(time.micros(F.col("ts")) / 1e6)
    return t.events.select(
        "event_id", time.age_seconds(F.col("ts"), now).alias("age"), time.age_of_epoch(whole, now).alias("age_of_number"),
    )


@query(
    "fn_render",
    """SELECT l_orderkey::VARCHAR AS key, l_quantity::VARCHAR AS quantity, l_discount::VARCHAR AS discount,
              (l_returnflag = 'R')::VARCHAR AS returned, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS shipped, l_returnflag AS flag
       FROM lineitem""",
)
def fn_render(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("returned", F.col("l_returnflag") == "R")
    types = {f.name: f.dataType for f in lines.schema.fields}
    names = {
        "l_orderkey": "key", "l_quantity": "quantity", "l_discount": "discount", "returned": "returned", "l_shipdate": "shipped",
        "l_returnflag": "flag",
    }
    return lines.select(*[value_text(F.col(c), types[c]).alias(alias) for c, alias in names.items()])


@query(
    "report_row_text",
    """SELECT 'doc_id=' || d.doc_id || ' lang=' || d.lang || ' quality=' || coalesce(l.quality::VARCHAR, 'null') AS line
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def report_row_text(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality")
    return joined.select(row_text(joined.schema).alias("line"))


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "varchar", "o_totalprice": "double"}


@query("source_paged", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def source_paged(t: Tables) -> DataFrame:
    """The orders, delivered in pages of text and read back by their declared types."""
    path = fresh_dir(t.spark, "paged")
    write_pages(t.orders, f"{path}/orders", ORDER_TYPES)
    return read_pages(t.spark, f"{path}/orders")
