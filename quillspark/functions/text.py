"""Text functions whose results equal Python's on every code point that transcripts use."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters at which Python's str.split() splits, the zero-width marks, Bengali digits, and the
#: repairs of Bengali letters that were typed as their parts: vowel letters (sequences that the Unicode Standard asks
#: not to use), khanda ta, letters with a nukta (which NFC takes apart), and vowel and other signs typed twice.
PY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
ZERO_WIDTH = r"[​‌‍﻿]"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
REPAIRS = {
    "\u0985\u09be": "\u0986",
    "\u098b\u09c3": "\u09e0",
    "\u098c\u09e2": "\u09e1",
    "\u09a4\u09cd\u200d": "\u09ce",
    "\u09a1\u09bc": "\u09dc",
    "\u09a2\u09bc": "\u09dd",
    "\u09af\u09bc": "\u09df",
    "\u09ac\u09bc": "\u09b0",
}
TWICE = re.compile("([\u0981-\u0983\u09bc\u09be-\u09c4\u09c7\u09c8\u09cb-\u09cd\u09d7])\\1+")
NORMALIZER_VERSION = "1.1.0+subset"
CODE_SWITCH_VERSION = "1.0.0+subset"


def repair(text: str | None) -> str | None:
    """NFC, then the Bengali repairs; what neither built-in function nor regular expression offers."""
    if text is None:
        return None
    text = unicodedata.normalize("NFC", TWICE.sub(r"\1", unicodedata.normalize("NFC", text)))
    for wrong, right in REPAIRS.items():
        text = text.replace(wrong, right)
    return text


@F.pandas_udf(StringType())
def nfc_repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def collapse_spaces(text: Column) -> Column:
    """" ".join(text.split()) of Python."""
    return F.trim(F.regexp_replace(text, PY_SPACE + "+", " "))


def strip(text: Column) -> Column:
    """text.strip() of Python."""
    return F.regexp_replace(text, rf"\A{PY_SPACE}+|{PY_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse_spaces(text), F.lit("")) == ""


def normalize(text: Column) -> Column:
    """Transcript normalisation: NFC and repair, zero-width marks go, punctuation and symbols become spaces, spaces
    collapse, Bengali digits become ASCII.  Letter case stays."""
    clean = F.regexp_replace(F.regexp_replace(nfc_repaired(text), ZERO_WIDTH, ""), r"[\p{P}\p{S}]", " ")
    return F.translate(collapse_spaces(clean), BENGALI_DIGITS, "0123456789")


def code_switch_normalize(text: Column) -> Column:
    """normalize, then full case folding."""
    return casefolded(normalize(text))


def normalize_for(domain: Column, text: Column) -> Column:
    """The normaliser of a slice's domain."""
    return F.when(domain == "code-switch", code_switch_normalize(text)).otherwise(normalize(text))


def script_counts(text: Column) -> dict[str, Column]:
    """Numbers of Bengali letters and marks, ASCII letters, digits and other non-space characters (after NFC)."""
    given = F.regexp_replace(nfc(text), PY_SPACE, "")

    def count(keep: str) -> Column:
        return F.length(F.regexp_replace(given, keep, "")).cast("long")

    digits = r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉]"
    bengali = r"[^[ঀ-৿&&[\p{L}\p{M}]]]"
    latin = r"[^A-Za-z]"
    counts = {"bengali": count(bengali), "latin": count(latin), "digit": count(digits)}
    return counts | {"other": F.length(given).cast("long") - counts["bengali"] - counts["latin"] - counts["digit"]}


def bengali_fraction(text: Column) -> Column:
    """Share of Bengali among the letters, 1.0 where there are none."""
    counts = script_counts(text)
    letters = counts["bengali"] + counts["latin"]
    return F.when(letters == 0, 1.0).otherwise(counts["bengali"] / letters)


def is_code_switched(text: Column) -> Column:
    counts = script_counts(text)
    return (counts["bengali"] > 0) & (counts["latin"] > 0)


def escape_cell(text: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
