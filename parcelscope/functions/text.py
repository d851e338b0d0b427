"""Parcel numbers, owner names and street lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(*values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def any_word(patterns, flags: str = "") -> str:
    """A regex that finds any of the patterns as a whole word."""
    return rf"{flags}\b({'|'.join(patterns)})\b"


def strip(c) -> Column:
    """Without blanks, tabs, line breaks and no-break spaces at the ends."""
    return F.trim(as_col(c), F.lit(" \t\n\r\f\x0b\xa0"))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _upper(c) -> Column:
    return F.upper(F.coalesce(as_col(c), F.lit("")))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def normalize_apn(c) -> Column:
    return F.regexp_replace(_upper(c), "[^0-9A-Z]", "")


def normalize_owner_name(c) -> Column:
    cleaned = F.regexp_replace(_upper(c), "[.,]", " ")
    return squeeze(F.regexp_replace(cleaned, any_word(K.OWNER_NOISE_WORDS), " "))


def normalize_address(c) -> Column:
    return squeeze(F.regexp_replace(_upper(c), "[.,#]", " "))


_CITY_TAIL = " (" + "|".join(sorted(K.CITIES, key=len, reverse=True)) + ")$"


def street_only(c) -> Column:
    """Street line without one trailing city name, normalised."""
    return normalize_address(F.regexp_replace(strip(_upper(c)), _CITY_TAIL, ""))


def sorted_name_key(c) -> Column:
    return F.array_join(F.array_sort(split_words(normalize_owner_name(c))), " ")


_UNIT_TAIL = r"\s(" + "|".join(K.UNIT_MARKERS) + r")\s.*$"


def _expand_alias(token: Column) -> Column:
    out = token
    for short, full in K.STREET_WORD_ALIASES.items():
        out = F.when(token == short, F.lit(full)).otherwise(out)
    return out


def address_match_key(c) -> Column:
    """House number and core street name: no directionals, street types or unit."""
    spaced = F.regexp_replace(F.regexp_replace(_upper(c), "[.,]", " "), "#", " # ")
    before_unit = F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), _UNIT_TAIL, "")
    tokens = F.filter(split_words(before_unit), lambda t: ~t.isin(K.DIRECTIONALS))
    tokens = F.transform(tokens, _expand_alias)
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(K.STREET_TYPES)), " ")


def zip5(c) -> Column:
    return F.nullif(F.regexp_extract(as_col(c), r"\d{5}", 0), F.lit(""))


def same_street_address(addr_a, city_a, zip_a, addr_b, city_b, zip_b) -> Column:
    """Same street key, and the cities agree; zips only count when a city is missing."""
    key_a, key_b = address_match_key(addr_a), address_match_key(addr_b)
    ca, cb = blank_to_null(F.upper(as_col(city_a))), blank_to_null(F.upper(as_col(city_b)))
    za, zb = zip5(zip_a), zip5(zip_b)
    place = F.when(ca.isNotNull() & cb.isNotNull(), ca == cb).otherwise(
        F.coalesce(za == zb, F.lit(True))
    )
    return (key_a != "") & (key_a == key_b) & place


def absentee_flag(mail_line, mail_city, mail_zip, situs_line, situs_city, situs_zip) -> Column:
    both = blank_to_null(mail_line).isNotNull() & blank_to_null(situs_line).isNotNull()
    same = same_street_address(mail_line, mail_city, mail_zip, situs_line, situs_city, situs_zip)
    return F.coalesce(both, F.lit(False)) & ~F.coalesce(same, F.lit(False))


def compose_mailing_address(line1, line2, city, state, zip_code) -> Column:
    parts = [blank_to_null(p) for p in (line1, line2, city, state, zip_code)]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def compose_situs_address(line, suite) -> Column:
    """Append the suite unless the line already ends with it."""
    street = strip(F.coalesce(as_col(line), F.lit("")))
    unit = strip(F.coalesce(as_col(suite), F.lit("")))
    last = F.coalesce(F.try_element_at(split_words(street), F.lit(-1)), F.lit(""))
    add = (unit != "") & (F.upper(last) != F.upper(unit))
    return F.nullif(F.when(add, F.concat(street, F.lit(" "), unit)).otherwise(street), F.lit(""))


def parse_legal_class(c) -> Column:
    return F.nullif(F.regexp_extract(as_col(c), r"\d+%\s*([^\s;,]+)", 1), F.lit(""))


def numeric_or_null(c) -> Column:
    """Number, with blank, junk and zero as NULL. Only digits, sign, point and exponent make a number."""
    text = strip(c)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), F.nullif(number, F.lit(0.0)))


def year_built(c) -> Column:
    year = strip(c)
    return F.when(year.rlike(r"^\d{4}$"), year.try_cast("int"))


def csv_list(c, lower: bool = False) -> Column:
    items = F.transform(F.split(F.coalesce(as_col(c), F.lit("")), ","), lambda t: strip(t))
    if lower:
        items = F.transform(items, F.lower)
    return F.filter(items, lambda t: t != "")


def is_entity_owner(c) -> Column:
    """Organisation or placeholder instead of a homeowner. NULL name gives NULL."""
    name = as_col(c)
    entity = name.rlike(any_word(K.REPORT_ENTITY_WORDS, "(?i)"))
    placeholder = F.trim(name).rlike(f"(?i)^({'|'.join(K.PLACEHOLDER_OWNERS)})$")
    return entity | placeholder


def is_institution(c) -> Column:
    return as_col(c).rlike(any_word(K.INSTITUTION_PATTERNS, "(?i)"))


def pick_document_owner(names) -> Column:
    """First party of a document that is not an institution, else the first party."""
    parties = as_col(names)
    person = F.get(F.filter(parties, lambda n: ~is_institution(n)), F.lit(0))
    return blank_to_null(F.coalesce(person, F.get(parties, F.lit(0))))


def email_domain(c) -> Column:
    """Lower-cased text after the last @, 'unknown' when there is none."""
    email = F.coalesce(as_col(c), F.lit(""))
    return F.when(F.instr(email, "@") == 0, F.lit("unknown")).otherwise(
        F.lower(F.substring_index(email, "@", -1))
    )
