"""Synthetic replacements as a pure function of (salt, type, key).

A keyed SHA-256 picks entries of small lists, so equal entities get equal
replacements on every executor, in every order, without any shared state.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from . import fixed_values as fv, normalise as n, validators as v

DEFAULT_AS_OF = "2025-01-01"

FIRST_NAMES = (
    "Aarav", "Aditi", "Akash", "Amrita", "Anil", "Bhavna", "Chirag", "Deepa", "Dev", "Esha",
    "Farhan", "Gauri", "Harsh", "Indira", "Ishaan", "Jaya", "Karan", "Kavya", "Lalit", "Mala",
    "Mohan", "Neha", "Nikhil", "Ojas", "Pallavi", "Pranav", "Radha", "Rohan", "Sanjana", "Tarun",
    "Uma", "Vikram",
)
LAST_NAMES = (
    "Acharya", "Bansal", "Bhatt", "Chandra", "Chopra", "Dalal", "Desai", "Dutta", "Gandhi", "Goyal",
    "Gupta", "Jain", "Kapoor", "Khanna", "Kulkarni", "Lal", "Mehta", "Mishra", "Nair", "Naidu",
    "Pandey", "Pillai", "Prasad", "Reddy", "Saxena", "Sethi", "Sharma", "Sinha", "Tiwari", "Trivedi",
    "Varma", "Yadav",
)
COMPANY_WORDS = (
    "Amber", "Banyan", "Cedar", "Drishti", "Ember", "Falcon", "Garnet", "Horizon", "Indigo", "Jasmine",
    "Kestrel", "Lotus", "Meridian", "Nimbus", "Orchid", "Pioneer",
)
STREETS = (
    "Ashoka Road", "Banyan Street", "Canal Lane", "Garden Marg", "Hill Road", "Lake Avenue",
    "Market Street", "River Lane",
)
CITIES = (
    ("Amravati", "Maharashtra", "444"), ("Bhopal", "Madhya Pradesh", "462"),
    ("Coimbatore", "Tamil Nadu", "641"), ("Guwahati", "Assam", "781"),
    ("Indore", "Madhya Pradesh", "452"), ("Kochi", "Kerala", "682"),
    ("Mysuru", "Karnataka", "570"), ("Udaipur", "Rajasthan", "313"),
)


def pick(options, number: Column) -> Column:
    """The option at number modulo length; one string split keeps the literal small."""
    return F.element_at(
        F.split(F.lit("|".join(options)), r"\|"), (number % len(options)).cast("int") + 1
    )


def _number(digest: Column, i: int) -> Column:
    """The i-th of eight 32-bit numbers in a SHA-256 digest."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _unlike(key: Column, made: Column, next_made: Column) -> Column:
    """Never hand back the original itself."""
    return F.when(F.lower(made) == F.lower(key), next_made).otherwise(made)


def full_name(key: Column, num) -> Column:
    last = pick(LAST_NAMES, num(1))
    return _unlike(
        key,
        F.concat_ws(" ", pick(FIRST_NAMES, num(0)), last),
        F.concat_ws(" ", pick(FIRST_NAMES, num(0) + 1), last),
    )


def email(key: Column, num) -> Column:
    tail = F.concat(F.lit("."), F.lower(pick(LAST_NAMES, num(1))), F.lit("@" + fv.EMAIL_DOMAIN))
    return _unlike(
        key,
        F.concat(F.lower(pick(FIRST_NAMES, num(0))), tail),
        F.concat(F.lower(pick(FIRST_NAMES, num(0) + 1)), tail),
    )


def phone(key: Column, num) -> Column:
    """The shape follows the key's digits: country code, Pune area code, or neither."""
    return (
        F.when(
            (F.length(key) == 12) & key.startswith("91"),
            F.concat_ws(" ", F.lit("+91"), (num(0) % 40000 + 60000).cast("string"),
                        (num(1) % 90000 + 10000).cast("string")),
        )
        .when(
            F.contains(key, F.lit("20")),
            F.concat_ws(" ", F.lit("+91 20"), (num(0) % 8000 + 2000).cast("string"),
                        (num(1) % 9000 + 1000).cast("string")),
        )
        .otherwise(
            F.concat_ws(" ", F.lit("+91"), (num(0) % 3000000000 + 7000000000).cast("string"))
        )
    )


def company_form(key: Column) -> Column:
    """The legal form of the original, or the usual one."""
    lowered = F.lower(key)
    form = F.when(F.contains(lowered, F.lit(fv.COMPANY_FORMS[0].lower())), fv.COMPANY_FORMS[0])
    for other in fv.COMPANY_FORMS[1:]:
        form = form.when(F.contains(lowered, F.lit(other.lower())), other)
    return form.otherwise(fv.COMPANY_DEFAULT_FORM)


def company(key: Column, num) -> Column:
    return F.concat_ws(" ", pick(COMPANY_WORDS, num(0)), F.lit("Enterprises"), company_form(key))


def address(key: Column, num) -> Column:
    city, state, pin = (pick([c[i] for c in CITIES], num(2)) for i in range(3))
    return F.concat(
        (num(0) % 999 + 1).cast("string"), F.lit(" "), pick(STREETS, num(1)), F.lit(", "), city,
        F.lit(", "), state, F.lit(" – "), pin, _padded(num(3) % 1000, 3), F.lit(", India"),
    )


def ssn(key: Column, num) -> Column:
    """A valid number: area 001-665 or 667-899, group 01-99, serial 0001-9999."""
    area = num(0) % 898 + 1
    return F.concat_ws(
        "-",
        _padded(area + F.when(area >= 666, 1).otherwise(0), 3),
        _padded(num(1) % 99 + 1, 2),
        _padded(num(2) % 9999 + 1, 4),
    )


def card(key: Column, num) -> Column:
    made = pick(fv.TEST_CARDS, num(0))
    same = v.digits_only(key) == v.digits_only(made)
    return F.when(same, pick(fv.TEST_CARDS, num(0) + 1)).otherwise(made)


def dob(key: Column, num, as_of: str) -> Column:
    """A birth date 25 to 70 years before ``as_of``, in the format of the original."""
    youngest, oldest = fv.DOB_AGE_YEARS
    first_day = int(youngest * 365.25) + 1
    days = int((oldest + 1) * 365.25) - first_day + 1
    born = F.date_sub(F.to_date(F.lit(as_of)), (num(0) % days + first_day).cast("int"))
    return (
        F.when(F.contains(key, F.lit("/")), F.date_format(born, "dd/MM/yyyy"))
        .when(F.contains(key, F.lit("-")), F.date_format(born, "dd-MM-yyyy"))
        .otherwise(F.date_format(born, "dd MMMM yyyy"))
    )


def ipv4(key: Column, num) -> Column:
    """A private address in one of the three reserved ranges."""
    a, b, c = num(1) % 256, num(2) % 256, num(3) % 256
    block = num(0) % 3
    return F.concat_ws(
        ".",
        F.when(block == 0, F.concat(F.lit("10."), a.cast("string")))
        .when(block == 1, F.concat(F.lit("172."), (a % 16 + 16).cast("string")))
        .otherwise(F.lit("192.168")),
        b.cast("string"),
        c.cast("string"),
    )


def replacement(pii_type: Column, key: Column, digest: Column, as_of: str = DEFAULT_AS_OF) -> Column:
    """The synthetic value for an entity whose digest is already computed."""

    def num(i: int) -> Column:
        return _number(digest, i)

    return (
        F.when(pii_type == "FULL_NAME", full_name(key, num))
        .when(pii_type == "EMAIL", email(key, num))
        .when(pii_type == "PHONE", phone(key, num))
        .when(pii_type == "COMPANY", company(key, num))
        .when(pii_type == "ADDRESS", address(key, num))
        .when(pii_type == "SSN", ssn(key, num))
        .when(pii_type == "CREDIT_CARD", card(key, num))
        .when(pii_type == "DOB", dob(key, num, as_of))
        .when(pii_type == "IP_ADDRESS", ipv4(key, num))
        .otherwise(F.lit(fv.FALLBACK_REPLACEMENT))
    )


def digest(pii_type: Column, key: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), pii_type, key), 256)


@lru_cache(maxsize=16)
def _entities(spans: str, salt: str, as_of: str, jvm: object) -> Column:
    keyed = F.transform(
        F.col(spans),
        lambda s: F.struct(s.alias("span"), n.entity_key(s["pii_type"], s["value"]).alias("key")),
    )
    hashed = F.transform(
        keyed,
        lambda e: F.struct(
            e["span"].alias("span"),
            e["key"].alias("key"),
            digest(e["span"]["pii_type"], e["key"], salt).alias("digest"),
        ),
    )
    return F.transform(
        hashed,
        lambda e: F.struct(
            e["span"]["pii_type"].alias("pii_type"),
            e["span"]["rule"].alias("rule"),
            e["span"]["start"].alias("start"),
            e["span"]["end"].alias("end"),
            e["span"]["value"].alias("value"),
            e["key"].alias("key"),
            replacement(e["span"]["pii_type"], e["key"], e["digest"], as_of).alias("replacement"),
        ),
    )


def entities(spans: str, salt: str, as_of: str = DEFAULT_AS_OF) -> Column:
    """Spans of a column with their key and replacement added."""
    return _entities(spans, salt, as_of, SparkContext._jvm)
