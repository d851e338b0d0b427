"""Owner names to match keys (LAST|FIRST, both word orders for signals, =ENTITY).

Functions normalise the name first. Jobs that need several of them normalise once into a column and
pass normalized=True.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import any_word, as_col, squeeze

PERSONS_TYPE = "array<struct<last:string,first:string,middle:string>>"


def name_normalize(c) -> Column:
    upper = F.upper(F.coalesce(as_col(c), F.lit("")))
    joined = F.regexp_replace(upper, r"\bAND\b", "&")
    return squeeze(F.regexp_replace(joined, r"""[.,'"()\-]+""", " "))


def _name(c, normalized: bool) -> Column:
    return as_col(c) if normalized else name_normalize(c)


def is_entity_name(c, normalized: bool = False) -> Column:
    name = _name(c, normalized)
    return (name == "") | name.rlike(any_word(K.NAME_ENTITY_PATTERNS))


def person_tokens(part: Column) -> Column:
    return F.filter(
        F.split(part, " "),
        lambda t: (t != "") & ~t.isin(K.NAME_NOISE_WORDS) & ~t.rlike(r"^\d+$"),
    )


def _parts(name: Column) -> Column:
    """One struct per person part of a normalised name: its full words and its initials."""
    pieces = F.filter(F.split(name, r"\s*[/&]\s*"), lambda p: p != "")
    tokens = F.transform(pieces, person_tokens)
    return F.transform(
        tokens,
        lambda ts: F.struct(
            F.filter(ts, lambda t: F.length(t) > 1).alias("full"),
            F.filter(ts, lambda t: F.length(t) == 1).alias("initials"),
        ),
    )


def persons_from_owner(c, normalized: bool = False) -> Column:
    """Persons of a parcel owner name; a lone first name takes the surname before it."""
    name = _name(c, normalized)

    def add_part(acc, part):
        full, initials = part["full"], part["initials"]
        n = F.size(full)
        lone = (n == 1) & acc["last"].isNotNull()
        person = F.struct(
            F.when(lone, acc["last"]).otherwise(F.get(full, F.lit(0))).alias("last"),
            F.when(lone, F.get(full, F.lit(0))).otherwise(F.get(full, F.lit(1))).alias("first"),
            F.coalesce(
                F.when(~lone, F.get(full, F.lit(2))), F.get(initials, F.lit(0))
            ).alias("middle"),
        )
        surname = F.when((n == 0) | lone, acc["last"]).otherwise(F.get(full, F.lit(0)))
        persons = F.when(
            lone | (n >= 2), F.concat(acc["persons"], F.array(person))
        ).otherwise(acc["persons"])
        return F.struct(surname.alias("last"), persons.alias("persons"))

    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.array().cast(PERSONS_TYPE).alias("persons")
    )
    persons = F.aggregate(_parts(name), start, add_part, lambda acc: acc["persons"])
    return F.when(is_entity_name(name, True), F.array().cast(PERSONS_TYPE)).otherwise(persons)


def _key(last: Column, first: Column) -> Column:
    return F.concat(last, F.lit("|"), first)


def property_keys(c) -> Column:
    return F.array_distinct(
        F.transform(persons_from_owner(c), lambda p: _key(p["last"], p["first"]))
    )


def _usable_parts(name: Column) -> Column:
    return F.filter(_parts(name), lambda p: F.size(p["full"]) >= 2)


def signal_keys(c, normalized: bool = False) -> Column:
    """Keys for a name whose word order is unknown: LAST FIRST and FIRST LAST readings."""
    name = _name(c, normalized)
    per_part = F.transform(
        _usable_parts(name),
        lambda p: F.array(
            _key(F.get(p["full"], F.lit(0)), F.get(p["full"], F.lit(1))),
            _key(F.element_at(p["full"], -1), F.get(p["full"], F.lit(0))),
        ),
    )
    keys = F.array_distinct(F.flatten(per_part))
    return F.when(is_entity_name(name, True), F.array().cast("array<string>")).otherwise(keys)


def signal_middles(c, normalized: bool = False) -> Column:
    """Words of the name that may be a middle name or a middle initial."""
    name = _name(c, normalized)
    per_part = F.transform(
        _usable_parts(name),
        lambda p: F.concat(
            F.when(
                F.size(p["full"]) >= 3,
                F.array(F.get(p["full"], F.lit(2)), F.get(p["full"], F.lit(1))),
            ).otherwise(F.array().cast("array<string>")),
            p["initials"],
        ),
    )
    middles = F.array_distinct(F.flatten(per_part))
    return F.when(is_entity_name(name, True), F.array().cast("array<string>")).otherwise(middles)


def entity_key(c, normalized: bool = False) -> Column:
    name = squeeze(F.regexp_replace(_name(c, normalized), r"\bTHE\b", ""))
    return F.when(F.length(name) >= 4, F.concat(F.lit("="), name))


def lookup_keys(c, normalized: bool = False) -> Column:
    """All keys a signal's owner name is looked up under, in order of preference."""
    name = _name(c, normalized)
    entity = F.array_compact(F.array(entity_key(name, True)))
    return F.when(is_entity_name(name, True), entity).otherwise(signal_keys(name, True))
