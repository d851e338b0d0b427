"""Reports, matches and health as files. Inputs are already cut to the rows that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import display as X

# Column headers of the exports.
CSV_HEADER = [
    "rank", "score", "hot", "address", "city", "zip", "owner", "absentee", "mailing_address",
    "signal_types", "filed", "est_auction_date", "days_to_auction", "assessed_value",
    "last_sale_price", "years_owned", "apn", "owner_first", "owner_last", "mailing_street",
    "mailing_city", "mailing_state", "mailing_zip", "recorder_doc_number", "court_case_number",
    "source_urls", "first_seen",
]
MAPPED_HEADER = {
    "First Name": "owner_first", "Last Name": "owner_last", "Property Address": "address",
    "Property City": "city", "Property State": "state", "Property Zip": "zip",
    "Mailing Address": "mailing_street", "Mailing City": "mailing_city",
    "Mailing State": "mailing_state", "Mailing Zip": "mailing_zip", "APN": "apn",
}
MAPPED_EXTRAS = [
    "score", "hot", "signal_types", "filed", "est_auction_date", "days_to_auction",
    "assessed_value", "last_sale_price", "years_owned", "recorder_doc_number",
    "court_case_number", "source_urls", "first_seen",
]
FORMATS = ["csv", "batchleads", "propstream"]


def _yes_no(c: Column) -> Column:
    return F.when(c, "yes").when(~c, "no")


def _report_window() -> Window:
    # Only ever over the rows of one report, a top-k of at most a few hundred.
    return Window.orderBy(
        F.col("score").desc_nulls_last(), F.col("first_seen").desc(),
        F.col("apn").asc_nulls_last(), F.col("owner_name").asc_nulls_last(), F.col("signal_type"),
    )


def report_export(report: DataFrame, as_of, fmt: str = "csv") -> DataFrame:
    """Export columns of a web report; vendor formats map the first eleven. Unknown means csv."""
    owner = X.split_owner_name("owner_name", "is_entity")
    mail = X.mailing_fields(
        "absentee", "mailing_address", "situs_address", "situs_city", "situs_zip"
    )
    staged = report.withColumns({"o": owner, "m": mail})
    wide = staged.select(
        F.row_number().over(_report_window()).alias("rank"), "score",
        F.coalesce(_yes_no(F.col("is_hot")), F.lit("no")).alias("hot"),
        F.col("situs_address").alias("address"), F.col("situs_city").alias("city"),
        F.col("situs_zip").alias("zip"), F.col("owner_name").alias("owner"),
        _yes_no(F.col("absentee")).alias("absentee"), "mailing_address",
        F.coalesce("signal_types", "signal_type").alias("signal_types"),
        F.col("event_date").alias("filed"), "est_auction_date",
        D.days_to_auction("est_auction_date", as_of).alias("days_to_auction"),
        "assessed_value", "last_sale_price", "years_owned", "apn",
        F.col("o.first").alias("owner_first"), F.col("o.last").alias("owner_last"),
        F.col("m.street").alias("mailing_street"), F.col("m.city").alias("mailing_city"),
        F.col("m.state").alias("mailing_state"), F.col("m.zip").alias("mailing_zip"),
        X.newest_external_id("signals", K.RECORDER_TYPES).alias("recorder_doc_number"),
        X.newest_external_id("signals", K.COURT_TYPES).alias("court_case_number"),
        X.source_urls_joined("signals").alias("source_urls"),
        F.to_date("first_seen").alias("first_seen"),
    ).orderBy("rank")
    if fmt not in FORMATS or fmt == "csv":
        return wide.select(*CSV_HEADER)
    return wide.withColumn("state", F.lit("AZ")).select(
        *[F.col(c).alias(header) for header, c in MAPPED_HEADER.items()], *MAPPED_EXTRAS
    )


def sink_report_csv(report: DataFrame, path: str, as_of, fmt: str = "csv") -> None:
    """A missing value is an empty cell, an empty text is a quoted one, so both can be told apart."""
    report_export(report, as_of, fmt).coalesce(1).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue='""', nullValue="", dateFormat="yyyy-MM-dd",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_report_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """An export as it was written, cells with quotes, commas and line breaks included. An empty cell that
    isn't quoted is read as the mark below, which stands for a missing value."""
    return spark.read.schema(schema).csv(
        path, header=True, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\u2400", dateFormat="yyyy-MM-dd", mode="FAILFAST")


def _cell(c, missing: str = "-") -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(missing))


def report_table_lines(report: DataFrame, as_of) -> DataFrame:
    """(ord, line) for the rows of a daily report."""
    ranked = report.withColumnRenamed("created_at", "first_seen").withColumn(
        "ord", F.row_number().over(_report_window())
    )
    same = (
        ~F.coalesce("absentee", F.lit(True)) & F.coalesce(F.col("situs_address") != "", F.lit(False))
        & F.coalesce(F.col("mailing_address") != "", F.lit(False))
    )
    address = F.coalesce(
        X.format_situs_address(F.nullif("situs_address", F.lit(""))),
        F.when(F.coalesce("apn", F.lit("")) != "", "(no situs on file)"), F.lit("(unresolved)"),
    )
    score = F.concat(_cell("score"), F.when(F.col("is_hot"), " \U0001F525").otherwise(""))
    cells = [
        F.col("ord").cast("string"), score, _cell("event_date"),
        D.auction_cell("est_auction_date", as_of), _cell("owner_name"), address,
        _cell("situs_city"), F.when(same, "same").otherwise(_cell("mailing_address")),
        F.when(F.col("absentee"), "Y").otherwise("N"), X.money_k("assessed_value"),
        _cell("years_owned"), F.coalesce("signal_types", "signal_type"),
    ]
    return ranked.select(
        "ord", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )


def _plural(n: Column, noun: str) -> Column:
    return F.concat(n, F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def report_headline(counts: DataFrame, as_of, hours: int, homeowners: bool) -> DataFrame:
    """(section, ord, line) above the table. The counts are one row per signal type."""
    day = F.to_date(D.as_of_col(as_of)).cast("string")
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("older_n"), F.lit(0)).alias("older"),
        F.sort_array(
            F.collect_list(
                F.when(
                    (F.col("n") > 0) & F.col("freshest").isNotNull(),
                    F.struct(
                        (-F.col("n")).alias("rank"), "signal_type",
                        F.concat(
                            F.regexp_replace("signal_type", "_", " "), F.lit(" "),
                            D.short_date("freshest"),
                        ).alias("text"),
                    ),
                )
            )
        ).alias("fresh"),
    )
    tail = ", homeowners only." if homeowners else "."
    top = F.transform(F.slice("fresh", 1, 3), lambda e: e["text"])
    lines = F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("# Daily Motivated Report for "), day).alias("line")),
        F.struct(F.lit(1).alias("section"), F.lit("").alias("line")),
        F.struct(F.lit(2).alias("section"), F.concat(
            _plural(F.col("n"), "new signal"), F.lit(f" in the last {hours}h{tail}")).alias("line")),
        F.struct(F.lit(4).alias("section"), F.when(F.size("fresh") > 0, F.concat(
            F.lit("Freshest filings: "), X.list_sentence(top), F.lit("."))).alias("line")),
        F.struct(F.lit(5).alias("section"), F.when(F.col("older") > 0, F.concat(
            F.lit("plus "), _plural(F.col("older"), "older filing"),
            F.lit(" newly detected (backfill), hidden below."))).alias("line")),
        F.struct(F.lit(6).alias("section"), F.lit("").alias("line")),
        F.struct(F.lit(7).alias("section"), F.lit(
            "| # | Score | Filed | Auction | Owner | Address | City | Mailing | Abs | Value ($k) | "
            "Owned (yrs) | Signals |").alias("line")),
        F.struct(F.lit(8).alias("section"), F.lit(
            "|---|-------|-------|---------|-------|---------|------|---------|-----|------------|"
            "-------------|---------|").alias("line")),
    )
    head = totals.select(F.explode(lines).alias("e")).select("e.section", F.lit(0).alias("ord"), "e.line")
    per_type = counts.where("n > 0").select(
        F.lit(3).alias("section"),
        F.row_number().over(Window.orderBy(F.col("n").desc(), "signal_type")).alias("ord"),
        F.concat(F.lit("- "), "signal_type", F.lit(": "), "n").alias("line"),
    )
    return head.where(F.col("line").isNotNull()).unionByName(per_type)


def report_markdown(
    report: DataFrame, counts: DataFrame, as_of, hours: int = 24, homeowners: bool = True
) -> DataFrame:
    """The lines of the text report in order."""
    rows = report_table_lines(report, as_of).select(F.lit(9).alias("section"), "ord", "line")
    head = report_headline(counts, as_of, hours, homeowners)
    return head.unionByName(rows).orderBy("section", "ord")


def health_lines(runs: DataFrame, drops: DataFrame) -> DataFrame:
    """(section, source, line) of the source-health table; runs holds one row per source."""
    seen = drops.select("source", "median", "warn")
    ok = F.col("status") == "ok"
    median = F.regexp_replace(F.col("median").cast("string"), r"\.0$", "")
    line = F.concat_ws(
        " | ", F.concat(F.lit("| "), "source"),
        _cell(F.when(ok, F.col("found").cast("string")), "—"), _cell(median, "—"),
        F.concat(F.when(F.col("warn"), "warn").otherwise(F.col("status")), F.lit(" |")),
    )
    head = [
        "## Source health", "", "| Source | Found today | 14-run median | Status |",
        "|--------|-------------|---------------|--------|",
    ]
    top = runs.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(h) for h in head])).alias("section", "line")
    ).select("section", F.lit("").alias("source"), "line")
    body = runs.join(seen, "source", "left").select(
        F.lit(len(head)).alias("section"), "source", line.alias("line")
    )
    return top.unionByName(body).orderBy("section", "source")


def matches_lines(shaped: DataFrame) -> DataFrame:
    """(rank, id, n, line) of the text form of nested matches."""
    lead = lambda i, x: F.concat(
        (i + 1).cast("string"), F.lit(". "), x["pitch_line"], F.lit(" _(match: "), x["match_tier"],
        F.lit("; owner: "), F.coalesce(x["owner_name"], F.lit("—")), F.lit(")_"),
    )
    title = F.concat(
        F.lit("## "), _cell("rank", "null"), F.lit(". "), "company",
        F.coalesce(F.concat(F.lit(" ("), F.nullif("segment", F.lit("")), F.lit(")")), F.lit("")),
    )
    contact = F.concat(
        F.lit("Contact: "), F.nullif("contact_name", F.lit("")),
        F.coalesce(F.concat(F.lit(" <"), F.nullif("email", F.lit("")), F.lit(">")), F.lit("")),
    )
    text = F.filter(
        F.concat(
            F.array(title), F.array(contact), F.array(F.lit("")),
            F.coalesce(F.transform("leads", lambda x, i: lead(i, x)), F.array().cast("array<string>")),
            F.array(F.lit("")),
        ),
        lambda s: s.isNotNull(),
    )
    return shaped.select("rank", "id", F.posexplode(text).alias("n", "line")).orderBy(
        F.col("rank").asc_nulls_last(), "id", "n"
    )


def sink_lines(lines: DataFrame, path: str) -> None:
    """Write ordered lines as one text file. For reports: a bounded number of rows."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def sink_report_markdown(report, counts, path: str, as_of, hours: int = 24, homeowners: bool = True):
    sink_lines(report_markdown(report, counts, as_of, hours, homeowners), path)


def sink_matches_json(shaped: DataFrame, path: str) -> None:
    shaped.write.mode("overwrite").json(path)


def sink_matches_markdown(shaped: DataFrame, path: str) -> None:
    """Sorted part files; the order of the files is the order of the prospects."""
    matches_lines(shaped).select("line").write.mode("overwrite").text(path)


def sink_source_health(runs: DataFrame, drops: DataFrame, path: str) -> None:
    sink_lines(health_lines(runs, drops), path)
