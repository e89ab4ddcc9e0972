"""Validators, keys and replacements."""

import random
import re

import brute
from pyspark.sql import functions as F

from maskwright.functions import fixed_values as fv, normalise as n, surrogates as su, validators as v


def column(spark, values, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_luhn(spark):
    rng = random.Random(4)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(10, 21))) for _ in range(300)]
    numbers += ["4111 1111 1111 1111", "4111-1111-1111-1112", "4000 0012 3456 7890", ""]
    assert column(spark, numbers, v.luhn_valid) == [brute.luhn(x) for x in numbers]


def test_ssn(spark):
    got = column(spark, ["123-45-6789", "000-12-3456", "666-45-6789", "950-12-3456", "123-00-1234", "123-45-0000", "123"], v.ssn_valid)
    assert got == [True] + [False] * 6


def test_ipv4(spark):
    got = column(spark, ["192.168.1.25", "192.168.1.256", "300.0.0.1", "1.2.3", "01.2.3.4", "0.0.0.0", "1.2.3.99999999999"], v.ipv4_valid)
    assert got == [True, False, False, False, False, True, False]


def test_title_case_is_pythons(spark):
    names = ["o'neil mc-dOUGAL", "asha  RAO", "b2b traders llp", "élan VITAL"]
    assert column(spark, names, n.title_case) == [x.title() for x in names]


def test_keys(spark):
    rows = [("EMAIL", " A@B.Org "), ("PHONE", "+91 20-7718 6640"), ("PHONE", "12 34"), ("FULL_NAME", " asha \n RAO "), ("SSN", " 1 ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, x string")
    got = [r.k for r in df.select("i", n.entity_key(F.col("t"), F.col("x")).alias("k")).orderBy("i").collect()]
    assert got == ["a@b.org", "912077186640", "12 34", "Asha Rao", "1"]


def made(spark, kind, keys):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    out = df.withColumn("d", su.digest(F.lit(kind), F.col("k"), "s"))
    return [r.r for r in out.select("i", su.replacement(F.lit(kind), F.col("k"), F.col("d")).alias("r")).orderBy("i").collect()]


def test_replacement_formats(spark):
    many = [f"key {i}" for i in range(400)]
    for x in made(spark, "SSN", many):
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x)
    assert all(brute.luhn(x) for x in made(spark, "CREDIT_CARD", many))
    assert set(made(spark, "CREDIT_CARD", many)) == set(fv.TEST_CARDS)
    own = [c.replace(" ", sep) for c in fv.TEST_CARDS for sep in (" ", "-", "")]
    assert not [a for a, b in zip(own, made(spark, "CREDIT_CARD", own)) if a.replace("-", "").replace(" ", "") == b.replace(" ", "")]
    for x in made(spark, "IP_ADDRESS", many):
        assert re.fullmatch(r"10\.\d+\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+", x)
        assert all(int(o) < 256 for o in x.split("."))
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+@example\.com", x) for x in made(spark, "EMAIL", many))
    assert all(re.fullmatch(r"\d+ [A-Za-z ]+, \w+, [A-Za-z ]+ – \d{6}, India", x) for x in made(spark, "ADDRESS", many))
    assert made(spark, "OTHER", ["x"]) == [fv.FALLBACK_REPLACEMENT]
    phones = made(spark, "PHONE", ["919812345210", "02077186640", "9812345111"])
    assert re.fullmatch(r"\+91 [6-9]\d{4} \d{5}", phones[0])
    assert re.fullmatch(r"\+91 20 \d{4} \d{4}", phones[1])
    assert re.fullmatch(r"\+91 [7-9]\d{9}", phones[2])
    dates = made(spark, "DOB", ["14/08/1998", "14-08-1998", "14 August 1998"])
    assert [bool(re.fullmatch(p, d)) for p, d in zip((r"\d\d/\d\d/\d{4}", r"\d\d-\d\d-\d{4}", r"\d\d [A-Z][a-z]+ \d{4}"), dates)] == [True] * 3
    firms = made(spark, "COMPANY", ["Acme Private Limited", "Acme Llp", "Acme Inc.", "Acme"])
    assert [f.split(" Enterprises ")[1] for f in firms] == ["Private Limited", "LLP", "Inc.", "Limited"]


def test_name_is_never_its_own_replacement(spark):
    names = [f"{a} {b}" for a in su.FIRST_NAMES for b in su.LAST_NAMES]
    assert not [a for a, b in zip(names, made(spark, "FULL_NAME", names)) if a == b]
