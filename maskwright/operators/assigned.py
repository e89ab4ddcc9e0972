"""Replacements that no two entities share, by a keyed permutation of numbered value spaces.

Hashed replacements (``surrogates``) need no shuffle, but draw from small lists: many people get
one name.  Here the distinct keys of a type are numbered, in the order of a keyed hash, and the
number is permuted within the type's value space, so distinct keys always get distinct values.
The permutation is a Feistel network over two digits of a mixed radix: a round adds a keyed hash of one
digit to the other, modulo that one's radix, so it can be undone and maps the space onto itself; no value
falls outside and none has to be drawn again.

Numbers depend on the set of keys alone, not on partitions: the same corpus gets the same values
on any cluster.  A larger corpus may give a key another value; keep the mapping where that matters.
A type with more keys than values is an error, never a shared value.  Payment cards are a fixed pool and
dates of birth keep their few thousand days: those two types stay as they are hashed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, spans as sp, surrogates as su
from ..session import stored

ROUNDS = 6  # three for each digit
BUCKETS = 1 << 10  # of the numbering
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: type (phones: type and shape) -> radices of the two digits of its value space
SPACES = {
    "FULL_NAME": (len(su.FIRST_NAMES) * 26 * 26, len(su.LAST_NAMES) ** 2),
    "EMAIL": (len(su.FIRST_NAMES) * len(su.LAST_NAMES), 10**7),
    "PHONE_INDIA": (10_000, 90_000),  # from 6 on; the other shape begins with 7, 8 or 9
    "PHONE_CITY": (8_000, 9_000),
    "PHONE": (30_000, 100_000),
    "COMPANY": (len(su.COMPANY_WORDS) ** 3, len(su.COMPANY_WORDS) ** 3),
    "ADDRESS": (999 * len(su.STREETS), len(su.CITIES) * 1000),
    "SSN": (898, 99 * 9999),
    "IP_ADDRESS": (256 + 16 + 1, 1 << 16),
}


def space_of(pii_type: Column, key: Column) -> Column:
    """The value space of an entity, null for types that are not numbered; phones keep their shape."""
    phone = (
        F.when((F.length(key) == 12) & key.startswith("91"), "PHONE_INDIA")
        .when(F.contains(key, F.lit("20")), "PHONE_CITY").otherwise("PHONE")
    )
    return F.when(pii_type == "PHONE", phone).when(pii_type.isin(*SPACES), pii_type)


def keyed_hash(salt: str, *parts: Column) -> Column:
    """A number below 2^48 from a keyed SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256), 1, 12), 16, 10).cast("long")


def permuted(numbers: DataFrame, salt: str) -> DataFrame:
    """``numbers`` (space, number) with the two digits of the permuted number, left and right.

    A number that its space doesn't hold is an error.
    """
    a, b = (F.coalesce(*[F.when(F.col("space") == k, F.lit(v[i])) for k, v in SPACES.items()]) for i in range(2))
    full = F.raise_error(F.concat(F.lit("more entities than values: "), "space"))
    out = numbers.withColumns({"_a": a.cast("long"), "_b": b.cast("long")}).withColumns({
        "left": F.when(F.col("number") < F.col("_a") * F.col("_b"), F.floor(F.col("number") / F.col("_b")).cast("long")).otherwise(full),
        "right": F.pmod("number", "_b"),
    })
    for i in range(ROUNDS):
        moved, other, radix = ("right", "left", "_b") if i % 2 else ("left", "right", "_a")
        step = keyed_hash(salt, F.lit(str(i)), F.col("space"), F.col(other).cast("string"))
        out = out.withColumn(moved, F.pmod(F.col(moved) + step, F.col(radix)))
    return out.drop("_a", "_b")


def _letter(n: Column) -> Column:
    return F.substring(F.lit(LETTERS), (n % 26 + 1).cast("int"), F.lit(1))


def _digits(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _tens(n: Column, size: int) -> Column:
    return F.floor(n / size).cast("long")


def value(space: str, key: Column, left: Column, right: Column) -> Column:
    """The replacement for a place (left, right) of a value space; different places differ."""
    names, last = len(su.FIRST_NAMES), len(su.LAST_NAMES)
    if space == "FULL_NAME":
        initials = F.concat(_letter(_tens(left, names)), F.lit(". "), _letter(_tens(left, names * 26)), F.lit("."))
        surname = F.concat(su.pick(su.LAST_NAMES, right), F.lit("-"), su.pick(su.LAST_NAMES, _tens(right, last)))
        return F.concat_ws(" ", su.pick(su.FIRST_NAMES, left), initials, surname)
    if space == "EMAIL":
        first, second = su.pick(su.FIRST_NAMES, left), su.pick(su.LAST_NAMES, _tens(left, names))
        return F.concat(F.lower(F.concat_ws(".", first, second, _digits(right, 7))), F.lit("@" + fv.EMAIL_DOMAIN))
    if space == "PHONE_INDIA":
        return F.concat_ws(" ", F.lit("+91"), (left + 60000).cast("string"), (right + 10000).cast("string"))
    if space == "PHONE_CITY":
        return F.concat_ws(" ", F.lit("+91 20"), (left + 2000).cast("string"), (right + 1000).cast("string"))
    if space == "PHONE":
        return F.concat(F.lit("+91 "), (left + 70000).cast("string"), _digits(right, 5))
    if space == "COMPANY":
        n = len(su.COMPANY_WORDS)
        words = [su.pick(su.COMPANY_WORDS, _tens(digit, n**i)) for digit in (left, right) for i in range(3)]
        return F.concat_ws(" ", *words, F.lit("Enterprises"), su.company_form(key))
    if space == "ADDRESS":
        city, state, pin = (su.pick([c[i] for c in su.CITIES], _tens(right, 1000)) for i in range(3))
        return F.concat(
            (left % 999 + 1).cast("string"), F.lit(" "), su.pick(su.STREETS, _tens(left, 999)), F.lit(", "), city,
            F.lit(", "), state, F.lit(" – "), pin, _digits(right % 1000, 3), F.lit(", India"),
        )
    if space == "SSN":
        area = left + 1
        return F.concat_ws(
            "-", _digits(area + F.when(area >= 666, 1).otherwise(0), 3), _digits(_tens(right, 9999) + 1, 2), _digits(right % 9999 + 1, 4)
        )
    block = F.when(left < 256, F.concat(F.lit("10."), left.cast("string"))).when(
        left < 272, F.concat(F.lit("172."), (left - 240).cast("string"))
    ).otherwise(F.lit("192.168"))
    return F.concat_ws(".", block, _tens(right, 256).cast("string"), (right % 256).cast("string"))


def numbered(entities: DataFrame, salt: str) -> DataFrame:
    """(pii_type, key, space, number) of the distinct entities of numbered types.

    Numbers of a space run from 0 without gaps, by the keyed hash of the keys.  The hash's upper bits
    make buckets that are ranked each in a task of its own and shifted by the sizes of those before.
    """
    distinct = entities.select("pii_type", "key").distinct().withColumn("space", space_of(F.col("pii_type"), F.col("key")))
    hashed = stored(
        distinct.where(F.col("space").isNotNull()).withColumn("h", keyed_hash(salt, F.col("space"), F.col("key")))
        .withColumn("bucket", F.shiftright("h", 38).cast("int")),
        "entity-keys",
    )
    ranked = hashed.withColumn("at", F.row_number().over(Window.partitionBy("space", "bucket").orderBy("h", "key")).cast("long") - 1)
    sizes = hashed.groupBy(F.col("space").alias("_space"), F.col("bucket").alias("_bucket")).agg(F.count("*").alias("n"))
    # at most BUCKETS rows a space
    before = Window.partitionBy("_space").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_space", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    joined = ranked.join(F.broadcast(shifts), (F.col("space") == F.col("_space")) & (F.col("bucket") == F.col("_bucket")))
    return joined.select("pii_type", "key", "space", (F.col("at") + F.col("shift")).alias("number"))


def assigned(entities: DataFrame, salt: str) -> DataFrame:
    """(pii_type, key, replacement): one value for every distinct entity, shared with no other.

    ``entities`` holds pii_type and key, repeats and nulls included (null keys get nothing).  Types
    without a value space are left out.  More keys than values in a space are an error.
    """
    found = permuted(numbered(entities.where(F.col("key").isNotNull()), salt), salt)
    made = F.coalesce(*[
        F.when(F.col("space") == space, value(space, F.col("key"), F.col("left"), F.col("right"))) for space in SPACES
    ])
    return found.select("pii_type", "key", made.alias("replacement"))


def redact(df: DataFrame, keys: Sequence[str], salt: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """``df`` with its text redacted by assigned values and ``n_redactions``; entities of other
    types keep the replacement they have.

    ``keys`` name a row.  Only keys, entities and their hash are shuffled to meet the mapping; the
    texts are joined to what was found once, and rows without entities not at all.
    """
    mapped = stored(assigned(sp.unnest(df, [], entities, "e").select("e.pii_type", "e.key"), salt), "mapping")
    each = sp.unnest(df, keys, entities, "e")
    named = each.select(*keys, "e", F.xxhash64("e.pii_type", "e.key").alias("_h"), F.col("e.pii_type").alias("_t"), F.col("e.key").alias("_k"))
    side = mapped.select(
        F.xxhash64("pii_type", "key").alias("_h"), F.col("pii_type").alias("_type"), F.col("key").alias("_key"), F.col("replacement").alias("_to")
    )
    met = named.join(side, "_h", "left").where(
        F.col("_to").isNull() | ((F.col("_t") == F.col("_type")) & (F.col("_k") == F.col("_key")))
    )
    one = F.struct(
        F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.coalesce("_to", "e.replacement").alias("replacement")
    )
    cuts = met.select(*keys, one.alias("_one")).groupBy(*keys).agg(F.array_sort(F.collect_list("_one")).alias("_cuts"))
    few, many = df.where(F.size(entities) == 0), df.where(F.size(entities) > 0)
    spliced = many.join(cuts, list(keys)).withColumns(
        {text: sp.splice(F.col(text), F.col("_cuts"), lambda c: c["replacement"]), "n_redactions": F.size("_cuts").cast("long")}
    )
    return spliced.drop("_cuts").unionByName(few.withColumn("n_redactions", F.lit(0).cast("long")))
