"""Landed API pages to signal records: feature collections, row arrays, HTML pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import text as T
from ..schemas import SIGNAL_COLUMNS

FEATURE_PAGE = "features array<struct<attributes: map<string,string>>>"


def explode_features(pages: DataFrame) -> DataFrame:
    """One attribute map per feature of JSON pages (column `value`) with a `features` array. Pages that
    are no such thing are in `bad_pages`."""
    parsed = pages.select(F.from_json("value", FEATURE_PAGE).alias("page"))
    return parsed.select(F.explode("page.features").alias("f")).select("f.attributes")


def explode_rows(pages: DataFrame) -> DataFrame:
    """One attribute map per object of JSON pages (column `value`) that are arrays."""
    rows = F.from_json("value", "array<map<string,string>>")
    return pages.select(F.explode(rows).alias("attributes"))


def bad_pages(pages: DataFrame, shape: str = "features") -> DataFrame:
    """(value, reason) of pages that hold no data: not JSON as a whole, an error answer, or another
    shape. `shape` is "features" (an object with such an array) or "rows" (an array)."""
    text = F.nullif(T.strip("value"), F.lit(""))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.features" if shape == "features" else "$", "variant"))
    reason = (
        F.when(text.isNull(), "empty")
        .when(parsed.isNull(), "not JSON")
        .when(F.try_variant_get(parsed, "$.error", "variant").isNotNull(), "error answer")
        .when(~F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)), "no " + shape)
    )
    return pages.select("value", reason.alias("reason")).where(F.col("reason").isNotNull())


def good_pages(pages: DataFrame, shape: str = "features") -> DataFrame:
    """Pages that hold data, each text once: a page fetched twice counts once."""
    whole = pages.select("value").where(F.col("value").isNotNull()).dropDuplicates(["value"])
    return whole.join(bad_pages(pages, shape).select("value").distinct(), "value", "left_anti")


def scan_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(attribute map per feature, bad pages) of the feature-collection pages in a folder."""
    pages = spark.read.text(path, wholetext=True)
    return explode_features(good_pages(pages)), bad_pages(pages)


def scan_socrata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(attribute map per row, bad pages) of the pages of row objects in a folder."""
    pages = spark.read.text(path, wholetext=True)
    return explode_rows(good_pages(pages, "rows")), bad_pages(pages, "rows")


def require_good(rows: DataFrame, bad: DataFrame, source: str) -> DataFrame:
    """The rows, failing if any page of the source was bad; a truncated feed is not a quiet day."""
    n = bad.agg(F.count("*")).scalar()
    fail = F.raise_error(F.concat(F.lit(f"{source}: bad pages: "), n.cast("string")))
    return rows.where(F.when(n == 0, F.lit(True)).otherwise(fail.cast("boolean")))


def scan_html(spark: SparkSession, path: str, id_pattern: str = r"([^/]+?)(\.html?)?$") -> DataFrame:
    """Landed HTML pages as (page_id, html); the id comes from the file name."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), id_pattern, 1).alias("page_id"),
        F.col("value").alias("html"),
    )


def land_pages(pages: DataFrame, path: str) -> None:
    """Pages (page_id, html) as bundles: text files with one page per line, as JSON. A file for each page
    costs its making and its listing, which is most of the time from some ten thousand pages on."""
    pages.select(F.to_json(F.struct(F.col("page_id").cast("string").alias("page_id"), "html"))).write.text(path)


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, html) of all pages in bundles, as `scan_html` reads them from files of their own; a line
    that is no page fails."""
    return spark.read.schema("page_id string, html string").option("mode", "FAILFAST").json(path)


def _attr(*names: str) -> Column:
    """First attribute of the row that is present."""
    return F.coalesce(*[F.col("attributes")[n] for n in names])


def _record(rows: DataFrame, source: str, signal_type: str, **fields: Column) -> DataFrame:
    """Project to the record layout; rows without an id are left out (see `missing_ids`)."""
    nothing = F.lit(None).cast("string")
    base = {
        "signal_type": F.lit(signal_type),
        "source": F.lit(source),
        "source_url": F.lit(K.SOURCE_URLS.get(source)),
        "apn": nothing,
        "event_date": F.lit(None).cast("date"),
        "status": nothing,
        "owner_name": nothing,
        "situs_address": nothing,
        "raw": F.to_json("attributes") if "attributes" in rows.columns else nothing,
        **fields,
    }
    out = rows.select(*[base[c].alias(c) for c in SIGNAL_COLUMNS])
    return out.where(F.coalesce(F.col("external_id"), F.lit("")) != "")


def missing_ids(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of a feed that carry none of its id attributes."""
    return rows.where(F.coalesce(_attr(*names), F.lit("")) == "")


def _apn(*names: str) -> Column:
    return F.nullif(T.normalize_apn(_attr(*names)), F.lit(""))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def map_tax_delinquent(rows: DataFrame) -> DataFrame:
    apn = _apn("APN", "PARCEL", "Parcel", "PARCELNUM")
    return _record(
        rows, "treasurer_delinquent", "tax_delinquent",
        apn=apn, external_id=apn, status=F.lit("open"),
        situs_address=_attr(
            "PropertyFullStreetAddress", "PHYSICAL_ADDRESS", "SITUS_ADDRESS", "SITE_ADDR"
        ),
    )


def map_code_county(rows: DataFrame) -> DataFrame:
    return _record(
        rows, "code_county", "code_violation",
        apn=_apn("APN"), external_id=_attr("CodeCaseNumber", "PermitCenterID", "OBJECTID"),
        event_date=D.epoch_ms_date(_attr("Opened")), status=_attr("Status"),
        situs_address=_attr("Address"),
    )


def map_code_glendale(rows: DataFrame) -> DataFrame:
    return _record(
        rows, "code_glendale", "code_violation",
        external_id=_attr("CodeCaseNumber", "ObjectID"),
        event_date=D.epoch_ms_date(_attr("RequestDate")), status=_attr("RequestStatus"),
        situs_address=_joined(
            F.nullif(_attr("StreetNum"), F.lit("0")), _attr("StreetName"), _attr("CityName")
        ),
    )


def map_code_tempe(rows: DataFrame) -> DataFrame:
    """One record per violation row; the case number is the key, so merging keeps one per case."""
    return _record(
        rows, "code_tempe", "code_violation",
        external_id=_attr("CaseNo", "Id", "OBJECTID"),
        event_date=D.epoch_ms_date(_attr("CaseOpenDate")), status=_attr("CaseStatus"),
        situs_address=_attr("Address"),
    )


def map_code_scottsdale(rows: DataFrame) -> DataFrame:
    return _record(
        rows, "code_scottsdale", "code_violation",
        apn=_apn("ParcelCode"), external_id=_attr("ViolationID", "ComplaintID"),
        event_date=D.epoch_ms_date(_attr("DateComplaintReceived")),
        status=_attr("ComplaintStatus"),
        situs_address=_joined(
            F.nullif(_attr("StreetNumber"), F.lit("0")), _attr("StreetDirection"),
            _attr("StreetName"), _attr("StreetType"),
        ),
    )


def map_code_mesa(rows: DataFrame) -> DataFrame:
    return _record(
        rows, "code_mesa", "code_violation",
        apn=_apn("parcel_number"), external_id=_attr("permit_number", "record_id", ":id"),
        event_date=D.iso_prefix_date(_attr("opened_date")), status=_attr("status"),
        situs_address=_attr("case_address"),
    ).where(F.col("external_id") != "undefined")


def combine_sources(*records: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)


# --- HTML pages ------------------------------------------------------------------------------

_ENTITIES = [("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
             ("&amp;", "&")]


def html_text(c: Column) -> Column:
    """Visible text of a fragment: tags removed, common entities decoded, ends trimmed."""
    text = F.regexp_replace(c, "(?s)<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_text(html: Column) -> Column:
    """The title of a page. It is raw text, so tags in it stay; `&amp;` is decoded and outer spaces go."""
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    return F.regexp_replace(F.replace(title, F.lit("&amp;"), F.lit("&")), r"^\p{Zs}+|\p{Zs}+\z", "")


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def labelled_cell(html: Column, label: str) -> Column:
    """The value cell in the same row as a bold label; blank without the label."""
    return F.regexp_extract(
        html,
        rf'(?s)<strong>\s*{label}\s*</strong>(?:(?!<strong>).)*?'
        rf'class="[^"]*\bcol-md-9\b[^"]*"[^>]*>(.*?)</div>',
        1,
    )


def cell_text(cell: str) -> Column:
    """Text of a cell's first paragraph, or of the whole cell; NULL when blank."""
    inner = F.regexp_extract(cell, r"(?s)<p[^>]*>(.*?)</p>", 1)
    return F.nullif(html_text(F.when(inner != "", inner).otherwise(F.col(cell))), F.lit(""))


def extract_code_case_html(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """City code-case pages; a page whose heading lacks its case number is no case."""
    html, case = F.col("html"), F.col(id_col)
    labels = {"address": "Address:", "case_status": "Case Status:", "opened": "Case Opened:",
              "party": "Responsible Party:"}
    cells = pages.where(F.contains(html, F.concat(F.lit("Case Details - "), case))).select(
        case.alias("case_id"),
        *[labelled_cell(html, label).alias(name) for name, label in labels.items()],
    )
    fields = cells.select("case_id", *[cell_text(name).alias(name) for name in labels])
    whole_date = F.when(F.col("opened").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.col("opened"))
    return _record(
        fields, "phoenix_code", "code_violation",
        external_id=F.col("case_id"),
        source_url=F.concat(F.lit(K.SOURCE_URLS["phoenix_code"]), F.url_encode("case_id")),
        event_date=D.parse_us_date(whole_date),
        status=F.col("case_status"), owner_name=F.col("party"), situs_address=F.col("address"),
        raw=F.to_json(F.struct("case_id", "address", "case_status", "opened", "party")),
    )


_REC = "ctl00_ContentPlaceHolder1_"


def _span(html: Column, element: str) -> Column:
    return _first(html, rf'(?s)id="{_REC}{element}"[^>]*>(.*?)</span>')


def extract_recorder_html(pages: DataFrame, source: str, signal_type: str) -> DataFrame:
    """Recorder detail pages; the owner is the first party that is not an institution."""
    html = F.col("html")
    number = F.regexp_replace(html_text(_span(html, "lblRecNum")), r"\s+", "")
    names = F.filter(
        F.transform(
            F.split(F.coalesce(_span(html, "lblRecDocName"), F.lit("")), r"(?i)<br\s*/?>"),
            html_text,
        ),
        lambda n: n != "",
    )
    option = _first(html, rf'(?s)id="{_REC}lbRecDocCode".*?<option[^>]*>(.*?)</option>')
    code = F.trim(F.substring_index(html_text(_span(html, "lblRecDocCode")), "\n", 1))
    fields = pages.select(
        number.alias("number"), names.alias("names"),
        html_text(_span(html, "lblRecDate")).alias("recorded"),
        F.coalesce(code, html_text(option), F.lit("")).alias("doc_type"),
    ).where(F.col("number").rlike(r"^\d+$"))
    return _record(
        fields, source, signal_type,
        external_id=F.col("number"),
        source_url=F.concat(F.lit(K.SOURCE_URLS["recorder"]), F.col("number")),
        event_date=D.parse_us_date("recorded"), status=F.lit("active"),
        owner_name=T.pick_document_owner("names"),
        raw=F.to_json(F.struct("doc_type", "names", "recorded")),
    )


def extract_recorder_list_html(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Recording numbers of list pages, with the cursor of the page they came from."""
    html = F.col("html")
    grid = F.regexp_extract(html, rf'(?s)<table[^>]*id="{_REC}Grid1".*?</table>', 0)
    rows = F.regexp_extract_all(grid, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))
    numbers = F.transform(
        rows, lambda r: html_text(F.regexp_extract(r, r"(?s)<td.*?<a[^>]*>(.*?)</a>", 1))
    )
    cursor = _first(html, rf'id="{_REC}hiddenrec"[^>]*\bvalue="\s*([^"]*?)\s*"')
    return pages.select(
        F.col(id_col).alias("page_id"), cursor.alias("cursor"),
        F.explode(F.filter(numbers, lambda n: n.rlike(r"^\d+$"))).alias("rec_number"),
    )


def _parties(html: Column, row_id: str) -> Column:
    """(name, relationship) of every party block of a court page."""
    blocks = F.split(html, f'id="{row_id}"')

    def party(block):
        def cell(css):
            raw = F.regexp_extract(
                block, rf'(?s)class="[^"]*\b{css}\b[^"]*"[^>]*>(.*?)</div>', 1
            )
            return T.squeeze(html_text(raw))

        return F.struct(cell("col-lg-4").alias("name"), cell("col-lg-3").alias("relationship"))

    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks), F.lit(1))), party)


def _first_filing(html: Column) -> Column:
    cells = F.regexp_extract_all(
        html,
        F.lit(
            r'(?s)class="[^"]*\bcol-4\b[^"]*\bm-visibility\b[^"]*"[^>]*>\s*Filing Date\s*</div>'
            r"\s*<div[^>]*>(.*?)</div>"
        ),
        F.lit(1),
    )
    return F.array_min(
        F.transform(
            cells,
            lambda c: D.parse_us_date(F.regexp_extract(c, r"\d{1,2}/\d{1,2}/\d{4}", 0)),
        )
    )


def _party_named(parties: str, relationship: str) -> Column:
    hits = F.filter(parties, lambda p: p["relationship"] == relationship)
    return F.nullif(F.get(hits, F.lit(0))["name"], F.lit(""))


def extract_probate_html(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Probate case pages that name a decedent."""
    case = F.col(id_col)
    fields = pages.where(F.contains("html", F.lit("Decedent"))).select(
        case.alias("case_id"),
        _parties(F.col("html"), "tblForms3").alias("parties"),
        _first_filing(F.col("html")).alias("filed"),
    )
    named = fields.withColumn("decedent", _party_named("parties", "Decedent"))
    return _record(
        named.where(F.col("decedent").isNotNull()), "court_probate", "probate",
        external_id=F.col("case_id"),
        source_url=F.concat(F.lit(K.SOURCE_URLS["court_probate"]), F.col("case_id")),
        event_date=F.col("filed"), status=F.lit("open"), owner_name=F.col("decedent"),
        raw=F.to_json(F.struct("case_id", "decedent")),
    )


def extract_divorce_html(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Dissolution and legal-separation pages; petitioner, else respondent."""
    fields = pages.where(F.col("html").rlike("(?i)Dissolution of|Legal Separation")).select(
        F.col(id_col).alias("case_id"),
        F.filter(
            _parties(F.col("html"), "tblForms2"), lambda p: ~p["name"].isin("", "N/A")
        ).alias("parties"),
        _first_filing(F.col("html")).alias("filed"),
    )
    named = fields.select(
        "case_id", "filed",
        _party_named("parties", "Petitioner").alias("petitioner"),
        _party_named("parties", "Respondent").alias("respondent"),
    )
    owner = F.coalesce("petitioner", "respondent")
    return _record(
        named.where(owner.isNotNull()), "court_divorce", "divorce",
        external_id=F.col("case_id"),
        source_url=F.concat(F.lit(K.SOURCE_URLS["court_divorce"]), F.col("case_id")),
        event_date=F.col("filed"), status=F.lit("open"), owner_name=owner,
        raw=F.to_json(F.struct("case_id", "petitioner", "respondent")),
    )
