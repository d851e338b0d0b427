"""Labels and formatted cells for reports, pitches and exports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import as_col, csv_list, split_words, strip

_LOWER = "abcdefghijklmnopqrstuvwxyz"


def dim(values: dict, key: Column) -> Column:
    """Look a key up in a small fixed table; NULL when it is not there."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.try_element_at(table, key)


def _ascii_capital(c: Column) -> Column:
    return F.concat(
        F.translate(F.substring(c, 1, 1), _LOWER, _LOWER.upper()),
        F.substring(c, 2, 1 << 30),
    )


def _capital_piece(piece: Column) -> Column:
    marked = F.substring(piece, 1, 1).isin("-", "'")
    return F.when(
        marked, F.concat(F.substring(piece, 1, 1), _ascii_capital(F.substring(piece, 2, 1 << 30)))
    ).otherwise(_ascii_capital(piece))


def title_case(c) -> Column:
    """Readable case for county capitals; acronyms such as LLC or AZ stay upper."""

    def one(token):
        upper = F.upper(token)
        keep = F.regexp_replace(upper, "[^A-Z]", "").isin(K.KEEP_UPPER)
        pieces = F.regexp_extract_all(token, F.lit(r"[-']?[^-']+|[-']"), F.lit(0))
        return F.when(keep, upper).otherwise(
            F.array_join(F.transform(pieces, _capital_piece), "")
        )

    tokens = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"\s+|/|&|[^\s/&]+"), F.lit(0))
    return F.array_join(F.transform(tokens, one), "")


def format_situs_address(c) -> Column:
    """Drop a repeated trailing token and mark a unit after the street type with #."""
    tokens = split_words(as_col(c))

    def shaped(kept):
        places = F.sequence(F.lit(1), F.size(kept))
        types = F.filter(
            places, lambda i: F.upper(F.element_at(kept, i)).isin(K.STREET_TYPES)
        )
        at = F.coalesce(F.array_max(types), F.lit(0))
        unit = F.concat(
            F.array_join(F.slice(kept, F.lit(1), at), " "),
            F.lit(" #"),
            F.array_join(F.slice(kept, at + 1, F.size(kept)), " "),
        )
        return F.when((at == 0) | (at == F.size(kept)), F.array_join(kept, " ")).otherwise(unit)

    last = F.upper(F.element_at(tokens, -1))
    differing = F.filter(
        F.sequence(F.lit(1), F.size(tokens)), lambda i: F.upper(F.element_at(tokens, i)) != last
    )
    kept = F.slice(tokens, F.lit(1), F.coalesce(F.array_max(differing), F.lit(0)) + 1)
    # A one-element array binds the trimmed tokens once instead of repeating the expression.
    text = F.element_at(F.transform(F.array(kept), shaped), 1)
    return F.when(F.size(tokens) > 0, text).when(as_col(c).isNotNull(), F.lit(""))


def list_sentence(items) -> Column:
    parts = as_col(items)
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(
        F.concat(
            F.array_join(F.slice(parts, F.lit(1), n - 1), ", "),
            F.lit(" and "),
            F.element_at(parts, -1),
        )
    )


def label_signal_types(c) -> Column:
    """'probate,tax_delinquent' as 'Probate + tax delinquent'."""
    codes = F.array_distinct(csv_list(c))
    labels = F.transform(
        codes, lambda t: F.coalesce(dim(K.PITCH_LABELS, t), F.regexp_replace(t, "_", " "))
    )
    text = F.array_join(labels, " + ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def has_signal_type(types, signal_type: str) -> Column:
    return F.array_contains(csv_list(types), signal_type)


def lead_key(apn, owner_name, signal_type, situs_address) -> Column:
    rest = [F.coalesce(as_col(c), F.lit("")) for c in (owner_name, signal_type, situs_address)]
    return F.coalesce(as_col(apn), F.concat_ws("|", *rest))


def build_pitch_line(
    types, situs_address, situs_city, situs_zip, years_owned, absentee
) -> Column:
    blank = F.lit("")
    label = F.nullif(label_signal_types(types), blank)
    street = F.nullif(title_case(format_situs_address(F.nullif(as_col(situs_address), blank))), blank)
    city = F.nullif(title_case(F.nullif(as_col(situs_city), blank)), blank)
    place = F.concat_ws(
        " ", F.nullif(F.concat_ws(", ", street, city), blank), F.nullif(as_col(situs_zip), blank)
    )
    where = F.coalesce(F.nullif(place, blank), F.lit("(address unresolved)"))
    tenure = F.concat(F.lit("owned "), as_col(years_owned), F.lit(" yrs"))
    lives = F.when(as_col(absentee), "absentee").otherwise("owner-occupied")
    return F.concat_ws(" · ", label, where, tenure, lives)


def money_k(c) -> Column:
    thousands = F.floor(as_col(c) / 1000 + 0.5).cast("bigint")
    return F.coalesce(F.concat(F.lit("$"), thousands, F.lit("k")), F.lit("-"))


def one_decimal(x: Column) -> Column:
    """A number of 0 or more with one decimal, as printf('%.1f') writes it: its exact binary value is rounded,
    halves to the even digit. Java's formatter rounds the shortest decimal text instead (1.15 is below 1.15).

    The number is split into two halves of its bits, so its distance to the middle of two tenths is exact."""
    below = F.floor(x * 10)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    beyond = (high * 20 - (2 * below + 1)) + (x - high) * 20
    tenths = below + F.when((beyond > 0) | ((beyond == 0) & (below % 2 == 1)), 1).otherwise(0)
    written = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(x < 1e14, written).otherwise(F.format_string("%.1f", x))


def fmt_money(c) -> Column:
    amount = as_col(c)
    millions = F.concat(F.lit("$"), one_decimal(amount.cast("double") / 1_000_000), F.lit("m"))
    thousands = F.concat(F.lit("$"), F.floor(amount / 1000 + 0.5).cast("bigint"), F.lit("k"))
    return F.when(amount >= 1_000_000, millions).when(amount.isNotNull(), thousands)


# Fixed value: what marks a trust or an estate.
_TRUST_OR_ESTATE = r"(?i)\b(TRUST|TRUSTEES?)\b|\bESTATE OF\b"


def split_owner_name(name, is_entity) -> Column:
    """struct(first, last): LAST FIRST before a slash; trusts and companies whole in last."""
    raw = strip(F.coalesce(as_col(name), F.lit("")))
    tokens = split_words(F.substring_index(raw, "/", 1))
    whole = (
        F.coalesce(as_col(is_entity), F.lit(False))
        | raw.rlike(_TRUST_OR_ESTATE)
        | (F.size(tokens) == 0)
    )
    return F.struct(
        F.when(whole, F.lit(""))
        .otherwise(F.coalesce(F.get(tokens, F.lit(1)), F.lit("")))
        .alias("first"),
        F.when(whole, raw).otherwise(F.get(tokens, F.lit(0))).alias("last"),
    )


def mailing_fields(absentee, mailing_address, situs_address, situs_city, situs_zip) -> Column:
    """struct(street, city, state, zip); an owner-occupied parcel copies its situs."""
    home = F.coalesce(~as_col(absentee), F.lit(False))
    parts = F.transform(
        F.split(F.coalesce(as_col(mailing_address), F.lit("")), ","), lambda t: strip(t)
    )

    def pick(situs, i):
        mailed = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        return F.when(home, F.coalesce(situs, F.lit(""))).otherwise(mailed)

    return F.struct(
        pick(as_col(situs_address), 0).alias("street"),
        pick(as_col(situs_city), 1).alias("city"),
        pick(F.lit("AZ"), 2).alias("state"),
        pick(as_col(situs_zip), 3).alias("zip"),
    )


def newest_external_id(signals, types) -> Column:
    """External id of the first (newest) entry of a signal array with one of the types."""
    hits = F.filter(as_col(signals), lambda s: s["type"].isin(list(types)))
    return F.coalesce(F.get(hits, F.lit(0))["external_id"], F.lit(""))


def source_urls_joined(signals) -> Column:
    urls = F.filter(
        F.transform(as_col(signals), lambda s: s["source_url"]),
        lambda u: u.isNotNull() & (u != ""),
    )
    return F.coalesce(F.array_join(F.array_distinct(urls), "|"), F.lit(""))


def owner_initials(c) -> Column:
    """'SMITH JOHN A' as 'S. J. A.'."""
    tokens = split_words(as_col(c))
    marks = F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lit(".")))
    return F.when(F.size(tokens) == 0, as_col(c)).otherwise(F.array_join(marks, " "))


def owner_initials_mask(owner_name, types, is_entity) -> Column:
    """Initials for a person behind a probate or divorce signal; others unchanged."""
    sensitive = F.arrays_overlap(csv_list(types), F.array(F.lit("probate"), F.lit("divorce")))
    person = ~F.coalesce(as_col(is_entity), F.lit(False)) & (as_col(owner_name) != "")
    return F.when(sensitive & person, owner_initials(owner_name)).otherwise(as_col(owner_name))


def score_band(c) -> Column:
    score = as_col(c)
    return (
        F.when(score >= 80, "very_high")
        .when(score >= 60, "high")
        .when(score >= 35, "mid")
        .otherwise("low")
    )


def score_pct(c) -> Column:
    return F.least(F.lit(100), F.floor(as_col(c) / 160 * 100 + 0.5).cast("int"))


def is_urgent(signal_type) -> Column:
    return as_col(signal_type).isin(K.URGENT_TYPES)


def provenance_verb(signal_type) -> Column:
    return F.coalesce(dim(K.PROVENANCE_VERBS, as_col(signal_type)), F.lit("Recorded"))


def plural_label(signal_type) -> Column:
    t = as_col(signal_type)
    return F.coalesce(dim(K.PLURAL_LABELS, t), F.regexp_replace(t, "_", " "))


# Where a company name is cut, and the legal suffixes after it.
_COMPANY_CUT = r"( – | - | \(|,).*$"
_COMPANY_SUFFIX = rf"(?i)[,\s]+({'|'.join(K.COMPANY_SUFFIXES)})\.?$"


def short_company_name(c) -> Column:
    """Company name up to its first separator, without a legal suffix."""
    head = strip(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), f"(?s){_COMPANY_CUT}", ""))
    return strip(F.regexp_replace(head, _COMPANY_SUFFIX, ""))


def subject_for(variant, company, n7) -> Column:
    v, short = as_col(variant), short_company_name(company)
    unusable = (short == "") | (F.length(short) > 28) | short.rlike("(?i)s$")
    named = F.when(unusable, "your next maricopa seller?").otherwise(
        F.concat(short, F.lit("'s next maricopa seller?"))
    )
    return (
        F.when(v == "A", "who filed in maricopa this morning?")
        .when(v == "B", F.concat(as_col(n7), F.lit(" maricopa filings this week")))
        .when(v == "C", named)
        .when(v == "D", "before it hits propstream")
    )


def first_name(c) -> Column:
    return F.coalesce(
        F.get(split_words(F.coalesce(as_col(c), F.lit(""))), F.lit(0)), F.lit("there")
    )


def is_bot_user_agent(c) -> Column:
    ua = F.coalesce(as_col(c), F.lit(""))
    return (strip(ua) == "") | ua.rlike(f"(?i){'|'.join(K.BOT_PATTERNS)}")


def is_role_inbox(email) -> Column:
    e = F.coalesce(as_col(email), F.lit(""))
    local = F.substring_index(F.lower(F.substring_index(e, "@", 1)), "+", 1)
    return (F.instr(e, "@") > 0) & local.isin(K.ROLE_LOCAL_PARTS)


def site_domain(url) -> Column:
    u = as_col(url)
    full = F.when(F.instr(u, "://") > 0, u).otherwise(F.concat(F.lit("https://"), u))
    host = F.lower(F.try_parse_url(full, F.lit("HOST")))
    return F.regexp_replace(host, r"^www\.", "")


def is_third_party_domain(email, url) -> Column:
    e = F.coalesce(as_col(email), F.lit(""))
    domain = F.lower(F.substring(e, F.instr(e, "@") + 1, F.lit(1 << 30)))
    site = site_domain(F.nullif(as_col(url), F.lit("")))
    return (F.instr(e, "@") > 0) & F.coalesce(domain != site, F.lit(False))


def classify_inbox(email, url) -> Column:
    return F.when(is_role_inbox(email), "shared").when(
        is_third_party_domain(email, url), "third-party"
    )


def classify_delivery_error(code, response_code) -> Column:
    """Permanent failure of one recipient is a bounce; anything else stops the batch."""
    rc = as_col(response_code)
    bounce = rc.between(500, 599) & ~rc.isin(K.ABORT_RESPONSES)
    abort = F.coalesce(as_col(code).isin(K.ABORT_CODES), F.lit(False))
    return F.when(~abort & F.coalesce(bounce, F.lit(False)), "bounce").otherwise("abort")

