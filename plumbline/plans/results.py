"""What people read: health, counts, gauges, reports, digests, latest results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import ERROR, FAIL, FAILING, PASS, WARN

# Gauge codes, report icons and the digest's size limits in bytes.
STATUS_CODE = {PASS: 0, WARN: 1, FAIL: 2, ERROR: 3}
STATUS_UP = {PASS: 1, WARN: 1, FAIL: 0, ERROR: 0}
STATUS_ICON = {PASS: "PASS", WARN: "WARN", FAIL: "FAIL", ERROR: "ERR "}
DIGEST_BYTES, DIGEST_RESERVE, DIGEST_SAMPLES = 8192, 32, 2
HEALTHY, UNHEALTHY = 200, 503


def is_failing(status: str | Column = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*FAILING)


def _lookup(table: dict[str, object]) -> Column:
    out = F
    for status, value in table.items():
        out = out.when(F.col("status") == status, F.lit(value))
    return out


def results_filter(results: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Results with a status, in suite order, at most ``limit``."""
    if status is not None:
        results = results.where(F.col("status") == status.upper())
    ordered = results.orderBy("ord")
    return ordered if limit is None else ordered.limit(limit)


def results_health(results: DataFrame) -> DataFrame:
    """200 while nothing fails or errors (also when empty), else 503."""
    bad = F.count_if(is_failing())
    return results.agg(bad.alias("failing"), F.when(bad > 0, UNHEALTHY).otherwise(HEALTHY).alias("http_status"))


def results_summary(results: DataFrame) -> DataFrame:
    """Run counts; ``failed`` includes errors."""
    failed = F.count_if(is_failing())
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(F.col("status") == WARN).alias("warned"),
        failed.alias("failed"),
        F.count_if(F.col("status") == ERROR).alias("errored"),
        F.when(failed > 0, "fail").otherwise("pass").alias("status"),
    )


def escape_label(col: Column) -> Column:
    """A label value for the exposition text format."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def results_gauges(results: DataFrame) -> DataFrame:
    """Two gauges per check: status code, and whether it is up."""
    gauges = F.array(
        F.struct(F.lit("check_status").alias("metric"), _lookup(STATUS_CODE).alias("value")),
        F.struct(F.lit("check_up").alias("metric"), _lookup(STATUS_UP).alias("value")),
    )
    return results.select("ord", escape_label(F.col("check")).alias("check"), F.inline(gauges))


def gauge_text(results: DataFrame, prefix: str = "plumbline") -> DataFrame:
    """The gauges as exposition lines, ready to be written as text."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("metric"))
    line = F.concat(name, F.lit('{check="'), F.col("check"), F.lit('"} '), F.col("value").cast("string"))
    # The gauges' help texts.
    help_text = {
        "check_status": "Check status: 0=pass 1=warn 2=fail 3=error",
        "check_up": "1 if check is passing or warning, 0 otherwise",
    }
    lines = results_gauges(results).select("metric", F.col("ord"), line.alias("line"))
    heads = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("ord"), F.lit(text).alias("line"))
        for m, words in help_text.items()
        for k, text in ((-2, f"# HELP {prefix}_{m} {words}"), (-1, f"# TYPE {prefix}_{m} gauge"))
    ]
    head = results.sparkSession.range(1).select(F.inline(F.array(*heads)))
    return head.unionByName(lines).orderBy("metric", "ord").select("line")


def json_as_text(row: Column) -> Column:
    """A sample row's JSON as ``key=val key=val``: texts bare, other values as they are written."""
    keys = F.json_object_keys(row)
    values = F.from_json(row, "map<string,string>")
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(values, k), F.lit("null")))), " ")


def report_text(results: DataFrame) -> DataFrame:
    """The run as text lines: one per check, its sample rows as ``key=val`` texts indented below."""
    head = F.format_string("  [%s] %-32s %s", _lookup(STATUS_ICON), F.col("check"), F.col("detail"))
    rows = F.transform(F.col("sample"), lambda s: F.concat(F.lit("      "), json_as_text(s)))
    return results.select("ord", F.posexplode(F.concat(F.array(head), rows)).alias("line_no", "line"))


def json_string(col: Column) -> Column:
    """Text as a JSON string, quotes and escapes included."""
    wrapped = F.to_json(F.array(col))
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def report_json(results: DataFrame) -> DataFrame:
    """One JSON object per check: name, status, detail, sample."""
    body = F.concat(
        F.lit('{"name":'), json_string(F.col("check")), F.lit(',"status":'), json_string(F.lower("status")),
        F.lit(',"detail":'), json_string(F.col("detail")), F.lit(',"sample":['), F.array_join("sample", ","), F.lit("]}"),
    )
    return results.select("ord", body.alias("json"))


def report_yaml(results: DataFrame) -> DataFrame:
    """The same values as YAML, one text block per check; strings are JSON-quoted."""

    def entry(lead: str, name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{lead}{name}: "), json_string(value))

    rows = F.concat(F.lit("  sample:\n"), F.array_join(F.transform("sample", lambda s: F.concat(F.lit("  - "), s)), "\n"))
    block = F.concat_ws(
        "\n", entry("- ", "name", F.col("check")), entry("  ", "status", F.lower("status")), entry("  ", "detail", F.col("detail")),
        F.when(F.size("sample") == 0, "  sample: []").otherwise(rows),
    )
    return results.select("ord", block.alias("yaml"))


def failing_json(results: DataFrame) -> DataFrame:
    """One row: the failing checks as a JSON array of name, status, detail."""
    item = F.concat(
        F.lit('{"name":'), json_string(F.col("check")), F.lit(',"status":'), json_string(F.col("status")),
        F.lit(',"detail":'), json_string(F.col("detail")), F.lit("}"),
    )
    listed = F.array_sort(F.collect_list(F.struct("ord", item.alias("j"))))
    texts = F.array_join(F.transform(listed, lambda s: s.getField("j")), ",")
    return results.where(is_failing()).agg(F.concat(F.lit("["), texts, F.lit("]")).alias("failures_json"))


def failure_lines(results: DataFrame) -> DataFrame:
    """Failing checks, each as a headline and its first two sample rows."""
    head = F.concat(F.col("status"), F.lit("  "), F.col("check"), F.lit(" — "), F.col("detail"), F.lit("\n"))
    rows = F.transform(F.slice("sample", 1, DIGEST_SAMPLES), lambda s: F.concat(F.lit("  "), s, F.lit("\n")))
    return results.where(is_failing()).select(
        "ord", "check", "status", "detail", head.alias("head"), rows.alias("rows"),
    )


def failure_text(results: DataFrame) -> DataFrame:
    """The whole plain-text block of failing checks, in suite order."""
    lines = failure_lines(results).select("ord", F.concat(F.col("head"), F.array_join("rows", "")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "t")))
    return lines.agg(F.array_join(F.transform(ordered, lambda s: s.getField("t")), "").alias("failures"))


def failure_digest(results: DataFrame, title: str, suite: str, max_bytes: int = DIGEST_BYTES) -> DataFrame:
    """A size-bounded failure message: headline, failing checks, ``(+k more checks)``.

    A check is taken whole while it fits; a sample row that no longer fits is
    left out, and the first check whose headline does not fit ends the list.
    Works on result rows only: one per check of a run.
    """
    failed, total = F.count_if(is_failing()), F.count(F.lit(1))
    counts = results.agg(F.struct(failed.alias("failed"), total.alias("total")).alias("c")).scalar()
    words = F.format_string("%d/%d checks FAILED", counts.getField("failed"), counts.getField("total"))
    headline = F.concat(F.lit(f"{title}: "), words, F.lit(f' on "{suite}"\n'))
    budget = max_bytes - DIGEST_RESERVE

    def size(text: Column) -> Column:
        return F.octet_length(text)

    def add_sample(so_far: Column, row: Column) -> Column:
        fits = (so_far.getField("used") + size(row) <= budget) & so_far.getField("open")
        return F.struct(
            F.when(fits, F.concat(so_far.getField("body"), row)).otherwise(so_far.getField("body")).alias("body"),
            F.when(fits, so_far.getField("used") + size(row)).otherwise(so_far.getField("used")).alias("used"),
            fits.alias("open"),
        )

    def add_check(so_far: Column, item: Column) -> Column:
        head = item.getField("head")
        fits = so_far.getField("open") & (so_far.getField("used") + size(head) <= budget)
        start = F.struct(
            F.concat(so_far.getField("body"), head).alias("body"),
            (so_far.getField("used") + size(head)).alias("used"), F.lit(True).alias("open"),
        )
        grown = F.aggregate(item.getField("rows"), start, add_sample)
        return F.struct(
            F.when(fits, grown.getField("body")).otherwise(so_far.getField("body")).alias("body"),
            F.when(fits, grown.getField("used")).otherwise(so_far.getField("used")).alias("used"),
            fits.alias("open"),
            (so_far.getField("shown") + fits.cast("int")).alias("shown"),
        )

    items = F.array_sort(F.collect_list(F.struct("ord", "head", "rows")))
    gathered = failure_lines(results).agg(items.alias("items")).withColumn("headline", headline)
    start = F.struct(
        F.col("headline").alias("body"), size(F.col("headline")).alias("used"), F.lit(True).alias("open"), F.lit(0).alias("shown"),
    )
    packed = gathered.withColumn("fold", F.aggregate("items", start, add_check))
    more = F.size("items") - F.col("fold.shown")
    tail = F.when(more == 1, "(+1 more check)\n").when(more > 1, F.format_string("(+%d more checks)\n", more)).otherwise("")
    whole = F.concat(F.col("fold.body"), tail)
    return packed.select(_at_most(whole, max_bytes).alias("digest"), F.col("fold.shown").alias("shown"), more.alias("more"))


def _at_most(text: Column, n_bytes: int) -> Column:
    """The longest beginning of a text that takes no more than so many UTF-8 bytes and cuts no character."""
    data = F.encode(text, "UTF-8")
    # a character takes at most four bytes: step back over the continuation bytes at the cut
    back = F.lit(0)
    for k in (3, 2, 1):
        cut = F.conv(F.hex(F.substring(data, n_bytes - k + 1, 1)), 16, 10).cast("int")  # the k-th byte from the end
        length = F.when(cut >= 240, 4).when(cut >= 224, 3).when(cut >= 192, 2).otherwise(1)
        back = F.when((cut >= 192) & (length > k), F.lit(k)).otherwise(back)
    kept = F.decode(data.substr(F.lit(1), F.lit(n_bytes) - back), "UTF-8")
    return F.when(F.octet_length(text) <= n_bytes, text).otherwise(kept)


def run_payload(results: DataFrame, suite: str) -> DataFrame:
    """One row: the whole run as JSON, with the suite's name, its status, both counts and every check's name, status and detail."""
    item = F.concat(
        F.lit('{"name":'), json_string(F.col("check")), F.lit(',"status":'), json_string(F.lower("status")),
        F.lit(',"detail":'), json_string(F.col("detail")), F.lit("}"),
    )
    failed, total = F.count_if(is_failing()), F.count(F.lit(1))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("j")))), lambda s: s.getField("j")), ",")
    body = F.concat(
        F.lit('{"config":'), json_string(F.lit(suite)), F.lit(',"status":"'), F.when(failed > 0, "fail").otherwise("pass"),
        F.lit('","total":'), total.cast("string"), F.lit(',"failed":'), failed.cast("string"), F.lit(',"checks":['), listed, F.lit("]}"),
    )
    return results.agg(body.alias("payload"))


def explain(results: DataFrame, suite: DataFrame) -> DataFrame:
    """Results with the query behind them and a hint for failing ones."""
    tiers = suite.select("check", "query", "conditions")
    tier = F.when(F.array_contains("conditions", "fail"), "fail").otherwise("warn")
    # The hints' texts.
    hint = (
        F.when(F.col("status") == ERROR, F.concat(F.lit("An ERROR occurred evaluating the check condition: "), F.col("detail")))
        .when(
            F.col("status") == FAIL,
            F.concat(F.lit("The `"), tier, F.lit("` tier fired. "), F.col("detail"),
                     F.lit(" Review the sample rows below and the SQL query.")),
        )
        .otherwise("Check passed — no failure to explain.")
    )
    return results.join(tiers, "check", "left").select("ord", "check", "status", "detail", "query", "sample", hint.alias("hint"))


def results_latest(history: DataFrame) -> DataFrame:
    """The newest result of every check; folds in each task before the shuffle."""
    rest = [c for c in history.columns if c != "check"]
    newest = F.max_by(F.struct(*rest), F.col("run_at")).alias("latest")
    return history.groupBy("check").agg(newest).select("check", "latest.*")


