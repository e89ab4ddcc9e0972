"""Keys under which values count as the same entity, and text for fuzzy matching."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from . import fixed_values as fv, patterns as p, validators as v


def title_case(value: Column) -> Column:
    """Capital first letter in every run of letters, lower case elsewhere."""
    runs = F.regexp_extract_all(value, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def entity_key(pii_type: Column, value: Column) -> Column:
    """The normalised original: values with equal type and key get one replacement."""
    body = v.strip(value)
    digits = v.digits_only(body)
    return (
        F.when(pii_type == "EMAIL", F.lower(body))
        .when(
            pii_type == "PHONE",
            F.when(F.length(digits) >= fv.PHONE_KEY_MIN_DIGITS, digits).otherwise(body),
        )
        .when(pii_type.isin("FULL_NAME", "COMPANY"), title_case(v.collapse_blanks(value)))
        .otherwise(body)
    )


def fold(text: Column) -> Column:
    """Text in which letters that are equal when case is ignored are the same.

    Few texts hold a letter that lower-casing leaves apart, and those are looked for only in texts
    that are not all ASCII.
    """
    odd = reduce(or_, (F.contains(text, F.lit(letter)) for letter in p.FOLD_FROM))
    return F.when((F.octet_length(text) > F.length(text)) & odd, F.lower(F.translate(text, p.FOLD_FROM, p.FOLD_TO))).otherwise(
        F.lower(text)
    )


def match_text(value: Column) -> Column:
    """Lower case, with blanks and punctuation between words made one space."""
    return v.strip(F.regexp_replace(F.lower(value), p.java(fv.MATCH_SEPARATORS), " "))


def match_tokens(normalised: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalised, " ")), lambda w: w != "")
