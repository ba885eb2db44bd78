"""Results that a query service delivered in pages of text, read side by side and coerced by their declared types.

A page is one JSON document with ``columns`` (name and declared type) and ``rows`` (arrays of texts and nulls); the first page
(``page`` 0) may repeat the column names as its first row. Every page is a partition's work of its own: the reader only looks
at one page for the names and types, and no page passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import column, quote
from plumbline.sources.connections import Connection

PAGE = "page bigint, columns array<struct<name: string, type: string>>, rows array<array<string>>"
# Declared types that hold numbers or truth values; all others stay text.
WHOLE = ("tinyint", "smallint", "integer", "int", "bigint")
BROKEN = ("double", "float", "real", "decimal")


def coerced(text: Column, declared: str) -> Column:
    """A cell by its declared type; NULL where it cannot be read so (see :func:`read_pages` for such cells)."""
    kind = declared.lower().split("(")[0].strip()
    if kind in WHOLE:
        return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    if kind in BROKEN:
        return F.when(text == F.trim(text), text.try_cast("double"))
    if kind == "boolean":
        return F.when(text == "true", True).when(text == "false", False)
    return text


def read_pages(spark: SparkSession, path: str, header: bool = True, unread: str | None = None) -> DataFrame:
    """All rows of all pages below ``path``, one page to a file or a line.

    Numbers and truth values that cannot be read as declared are NULL; with ``unread`` a column of that name maps the names of
    such columns to their texts, so that rules can name them. Missing cells at the end of a row are NULL. Pages that declare
    other columns than the first one raise when they are read.
    """
    pages = spark.read.schema(PAGE).json(path)
    first = pages.where("columns IS NOT NULL").select("columns").first()
    if first is None:
        raise ValueError(f"no page with columns in {path}")
    names = [(c["name"], c["type"]) for c in first["columns"]]
    if len({n for n, _ in names}) < len(names):
        raise ValueError(f"columns of one name in {path}: {', '.join(quote(n) for n, _ in names)}")
    declared = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in names])
    skipped = F.when((F.col("page") == 0) & F.lit(header), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.col("rows"))
    same = F.assert_true(F.coalesce(F.col("columns"), declared) == declared, F.lit("a page declares other columns than the first"))
    rows = pages.where(same.isNull()).select(F.explode(skipped).alias("_row"))
    cells = [F.get("_row", F.lit(i)) for i in range(len(names))]
    values = [coerced(cell, t).alias(n) for cell, (n, t) in zip(cells, names, strict=True)]
    if unread is not None:
        lost = [F.when(cell.isNotNull() & coerced(cell, t).isNull(), F.struct(F.lit(n).alias("key"), cell.alias("value"))) for cell, (n, t) in zip(cells, names, strict=True)]
        values.append(F.map_from_entries(F.array_compact(F.array(*lost))).alias(unread))
    return rows.select(*values)


def write_pages(df: DataFrame, path: str, types: Mapping[str, str], rows_per_page: int = 1000, header: bool = True) -> None:
    """A table as pages, for tests and for handing results on; ``types`` declares its columns."""
    texts = F.array(*[column(c).cast("string") for c in types])
    numbered = df.select(texts.alias("row"), F.monotonically_increasing_id().alias("at"))
    paged = numbered.groupBy(F.expr(f"at div {rows_per_page}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("held"))
    rows = F.transform("held", lambda h: h["row"])
    names = F.array(F.array(*map(F.lit, types)))
    declared = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in types.items()])
    told = F.when(F.col("page") == 0, F.concat(names, rows)).otherwise(rows) if header else rows
    paged.select("page", declared.alias("columns"), told.alias("rows")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def paged_connection(name: str, root: str, tables: list[str], header: bool = True) -> Connection:
    """Results below ``root``, a folder of pages each, as tables."""
    return Connection(name, lambda spark: {t: read_pages(spark, f"{root}/{t}", header) for t in tables})
