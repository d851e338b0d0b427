"""Small awkward tables, and the word rules of the contract in plain Python."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text: str | None) -> list[str]:
    return words((text or "").translate(LOWER))


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


SHARED = prose(40, 999)

#: doc_id, text, lang, source, and a column that is named like results
DOCS = [
    (0, "A first text, quite short; nothing to see here at all, really nothing to see.", "en", "a", 1),
    (1, prose(80, 1), "en", "a", 2),
    (2, prose(80, 1), "en", "b", 3),  # an exact copy
    (3, prose(80, 1) + " tail", "en", "b", 4),  # a near copy
    (4, prose(30, 2) + " " + SHARED + " " + prose(30, 3), "de", "a", 5),
    (5, prose(20, 4) + "\n" + SHARED + "\t" + prose(25, 5), "de", "c", 6),
    (6, None, "en", "a", 7),
    (7, "", None, None, 8),
    (8, " \t\n ", "en", "a", 9),
    (9, "one two three", "fr", "a", 10),
    (10, "one  two\nthree", "fr", "a", 11),
    (11, "é ü ñ ß x – “quoted” 漢字 and\x0bmore\x0cwords İ", None, "c", 12),
    (12, " ".join(["again and again the same five words"] * 40), "en", "a", 13),
    (13, prose(12_000, 6, 3000), "en", "long", 14),
    (14, "the&&& the### of*** and%%% in$$$ a### to*** be&&& or%%% not$$$ | x", "en", "a", 15),
    (None, prose(50, 7), "en", "a", 16),
    (None, prose(80, 1), None, "a", 17),
    (15, prose(60, 8), "en", "a", 18),
    (15, prose(60, 8), "en", "a", 18),  # a repeated row
    (16, "UPPER " + prose(60, 8), "en", "a", 19),
    (17, prose(60, 9), "en", "b", 20),
    (17, prose(60, 10), "en", "b", 20),  # another text with the same id
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
