"""Checks and clean-ups applied to candidate values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv, patterns as p


def strip(value: Column) -> Column:
    """Trim every Unicode blank on both sides."""
    return F.trim(value, F.lit(p.BLANK_CHARS))


def strip_trailing_punctuation(value: Column) -> Column:
    return F.rtrim(value, F.lit(fv.TRAILING_PUNCTUATION))


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"\P{Nd}+", "")


def words(value: Column) -> Column:
    """Blank-separated words of a value."""
    return F.filter(F.split(value, p.java(r"\s+")), lambda w: w != "")


def collapse_blanks(value: Column) -> Column:
    return strip(F.regexp_replace(value, p.java(r"\s+"), " "))


def luhn_valid(value: Column) -> Column:
    digits = digits_only(value)
    return F.length(digits).between(*fv.CARD_DIGITS) & F.call_function("luhn_check", digits)


def ssn_valid(value: Column) -> Column:
    digits = digits_only(value)
    area = F.substring(digits, 1, 3)
    return (
        (F.length(digits) == 9)
        & ~area.isin("000", "666")
        & ~area.startswith("9")
        & (F.substring(digits, 4, 2) != "00")
        & (F.substring(digits, 6, 4) != "0000")
    )


def ipv4_valid(value: Column) -> Column:
    parts = F.split(value, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(
        parts,
        lambda o: F.rlike(o, F.lit(r"\A(?:0|[1-9][0-9]{0,2})\z")) & (o.try_cast("int") <= 255),
    )


def version_before(window: Column) -> Column:
    """A version marker stands shortly before a dotted quad."""
    return F.contains(F.lower(window), F.lit("v"))


def currency_before(window: Column) -> Column:
    """An amount or share marker stands shortly before a number."""
    found = F.contains(window, F.lit(fv.CURRENCY_TOKENS[0]))
    for token in fv.CURRENCY_TOKENS[1:]:
        found = found | F.contains(window, F.lit(token))
    return found


def company_allowed(value: Column) -> Column:
    """Not a stop phrase, not a statute or section, not just "The <suffix>"."""
    ok = ~value.isin(*fv.COMPANY_STOPS)
    for prefix in fv.COMPANY_BAD_PREFIXES:
        ok = ok & ~value.startswith(prefix)
    return ok & ~(value.startswith("The ") & (F.size(words(value)) == 2))


def not_stop_name(value: Column) -> Column:
    """Not a stop phrase and not starting with a verb that follows role words."""
    first = F.lower(F.regexp_extract(value, rf"\A[^{p.BLANKS}]+", 0))
    return ~value.isin(*fv.NAME_STOPS) & ~first.isin(*fv.NON_NAME_FIRST_WORDS)


def name_allowed(value: Column) -> Column:
    ok = not_stop_name(value)
    for token in fv.NAME_LEGAL_TOKENS:
        ok = ok & ~F.contains(value, F.lit(token))
    return ok


def drop_contact_terms(value: Column) -> Column:
    """Cut contact terms off the end, each listed term at most once, in list order."""
    return F.aggregate(
        F.array(*[F.lit(t) for t in fv.CONTACT_TERMS]),
        value,
        lambda v, term: F.when(
            F.endswith(v, term), strip(F.substring(v, F.lit(1), F.length(v) - F.length(term)))
        ).otherwise(v),
    )
