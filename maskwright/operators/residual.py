"""Originals that still stand in redacted texts of their document, or anywhere in a corpus.

A value has one anchor: the first start of a word inside it, or its beginning where it holds none.  What
stands before the anchor is the value's head, the rest its tail.  A text that contains the value has a word
starting at the same place, so only starts of words are looked up in texts.  A value that is one unbroken
word is looked up at every character of the kind that it begins with.

1. The beginnings of all tails, one a value, go into a Bloom filter; texts are cut into what follows each place, a row
   each, of which only those that pass it stay, so texts without candidates emit next to nothing.  Cutting is one regex
   pass a kind, and rows are hashed and tested in generated code, which lambdas over arrays are not; the filter is a
   broadcast table.  A kind and size with a few beginnings in all is looked up one by one instead, without cutting.
2. What passed is cut to the lengths that the tails of that beginning have, and joined to the tails by its hash.
   So many tails that begin alike are not held against many texts: a pair that is left has the tail, as far as
   ``WINDOW`` characters show it.
3. The text itself is searched for the tail, and what stands there before it is joined to the heads, again
   by hash.  Texts are never join keys, and are joined by their keys alone.

A frequent tail is a frequent key of these joins, whose partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import bloom, fixed_values as fv, spans as sp, validators as v
from ..session import stored
from . import redact as rd

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
LENGTHS = (12, 9, 7, 5, 3, 2, 1)  # characters of a piece, the beginning of a tail: the longest that fits
WINDOW = 48  # characters of a tail that are looked at before the text itself is searched
STARTS, NUMBER = "start", "number"
#: Where pieces of each kind begin in a text; those of numbers are digits throughout.
KINDS = {
    STARTS: rf"{NOT_WORD}(?={WORD})", NUMBER: "", "digit": r"(?=\p{Nd})", "letter": r"(?=[\p{L}_])", "other": "",
}
FEW = 16  # pieces of a kind and size, by estimate, up to which they are looked up one by one


def _hash(kind: str, size: int, piece: Column, scope: Sequence[str] = ()) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(size), piece, *scope)


def _quoted(literal: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _hits(
    body: DataFrame, keys: Sequence[str], sizes: dict[str, list[int]], listed: Sequence[Row], table: DataFrame, n_words: int,
    scope: Sequence[str] = (),
) -> DataFrame:
    """(keys, _h, _seen): the hashes of pieces of ``_text`` that may be a value's, and what stands from there.

    ``sizes`` are the lengths of pieces to cut at the places of each kind; ``listed`` pieces are looked
    up, and hold for any scope.
    """
    parts = []
    for kind, lengths in sizes.items():
        least, char = min(lengths), r"\p{Nd}" if kind == NUMBER else "."
        rest = F.regexp_extract_all("_text", F.lit(rf"(?s){KINDS[kind]}(?=({char}{{{least}}}.{{0,{WINDOW - least}}}))"), F.lit(1))
        each = sp.unnest(body, keys, F.array_distinct(rest), "_seen")
        hashes = [F.when(F.length("_seen") >= n, _hash(kind, n, F.substring("_seen", 1, n), scope)) for n in lengths]
        parts.append(bloom.passing(sp.unnest(each, [*keys, "_seen"], F.array(*hashes), "_h"), "_h", table, n_words))
    if listed:
        held = F.array(*[F.when(F.contains("_text", F.lit(r.piece)), F.struct(F.lit(r.h).alias("h"), F.lit(r.piece).alias("piece"))) for r in listed])
        met = sp.unnest(body, [*keys, "_text"], held, "_p")
        rest = F.regexp_extract_all("_text", F.concat(F.lit("(?s)(?=("), _quoted(F.col("_p.piece")), F.lit(f".{{0,{WINDOW}}}))")), F.lit(1))
        seen = sp.unnest(met.withColumn("_h", F.col("_p.h")), [*keys, "_h"], F.array_distinct(rest), "_seen")
        parts.append(seen.select(*keys, F.substring("_seen", 1, WINDOW).alias("_seen"), "_h"))
    return reduce(DataFrame.unionByName, parts)


def _anchored(values: DataFrame) -> DataFrame:
    """Values with their head, tail, kind of place, and the size of the tail's piece."""
    head = F.regexp_extract("value", rf"(?s)\A(.*?{NOT_WORD})(?={WORD})", 1)
    tail = F.substring("value", F.length("_head") + 1, F.length("value"))
    size = reduce(lambda fit, n: F.when(F.length("_tail") >= n, n).otherwise(fit), reversed(LENGTHS), F.lit(None).cast("int"))
    kind = (
        F.when(F.col("_head") != "", STARTS)
        .when(F.rlike(F.substring("_tail", F.lit(1), F.col("size")), F.lit(r"\A\p{Nd}+\z")), NUMBER)
        .when(F.rlike(F.substring("value", 1, 1), F.lit(r"\p{Nd}")), "digit")
        .when(F.rlike(F.substring("value", 1, 1), F.lit(r"[\p{L}_]")), "letter")
        .otherwise("other")
    )
    return values.withColumn("_head", head).withColumn("_tail", tail).withColumn("size", size).withColumn("kind", kind)


def originals(df: DataFrame, keys: Sequence[str] = (), entities: str = "entities") -> DataFrame:
    """The distinct values found: keys, pii_type, value."""
    return sp.unnest(df, keys, entities, "e").select(*keys, "e.pii_type", "e.value").distinct()


def standing(
    blocks: DataFrame, keys: Sequence[str], values: DataFrame, scope: Sequence[str] = (), text: str = "text",
) -> DataFrame:
    """(keys, pii_type, value) for every block whose text contains a value of its scope.

    ``keys`` name a block and ``scope`` those of them that block and value share; none for the whole
    corpus.  ``values`` holds scope, pii_type and value.  Empty and null values and null texts are
    in nothing; rows equal in keys and text count once.
    """
    taken = {"_h", "_p", "_seen", "_long", "_low", "_high", "_th", "_vh", "_head", "_tail", "_lead", "_text", "_value"} & {*blocks.columns, *values.columns}
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")
    spark = blocks.sparkSession
    parts = _anchored(values.where(F.col("value") != "").select(*scope, "pii_type", "value").distinct())
    piece = F.substring("_tail", F.lit(1), F.col("size"))
    wanted = stored(
        parts.withColumns({
            "piece": piece,
            "_lead": F.length("_head"),
            "_long": F.least(F.length("_tail"), F.lit(WINDOW)),
            "_vh": F.xxhash64("value"),
            "plain": F.xxhash64("kind", "size", piece),
            "_h": F.xxhash64("kind", "size", piece, *scope),
            "_th": F.xxhash64(F.substring("_tail", 1, WINDOW), *scope),
        }).withColumnRenamed("value", "_value").drop("_head"),
        "originals",
    )
    shape = wanted.groupBy("kind", "size").agg(F.approx_count_distinct("plain").alias("n"), F.approx_count_distinct("_h").alias("scoped")).collect()
    body = blocks.select(*keys, F.col(text).alias("_text"))
    if not shape:
        return spark.createDataFrame([], body.drop("_text").schema).join(values.select("pii_type", "value").limit(0))
    few, sizes = F.lit(False), {}
    for r in shape:
        if r.n <= FEW and not scope:
            few |= (F.col("kind") == r["kind"]) & (F.col("size") == r["size"])
        else:
            sizes.setdefault(r["kind"], []).append(r["size"])
    listed = wanted.where(few).select(F.col("_h").alias("h"), "piece").distinct().collect()
    table, n_words = bloom.words(wanted, "_h", sum(r.scoped for r in shape))
    hits = _hits(body, keys, sizes, listed, stored(table, "piece-filter"), n_words, scope)
    lengths = wanted.groupBy("_h", "_long").agg(F.min("_th").alias("_low"), F.max("_th").alias("_high"))
    cut = F.when(F.length("_seen") >= F.col("_long"), F.xxhash64(F.substring("_seen", F.lit(1), F.col("_long")), *scope))
    met = hits.join(lengths, "_h").withColumn("_th", cut).where(F.col("_th").between(F.col("_low"), F.col("_high")))
    tails = wanted.select(*scope, "_th", "_tail", "_lead").distinct()
    found = stored(met.select(*keys, "_th").join(tails, ["_th", *scope]).select(*keys, "_tail", "_lead").distinct(), "candidates")
    before = F.concat(F.lit("(?s)(?=(.{"), F.col("_lead").cast("string"), F.lit("})"), _quoted(F.col("_tail")), F.lit(")"))
    heads = sp.unnest(
        found.join(body, list(keys)), [*keys, "_tail"], F.array_distinct(F.regexp_extract_all("_text", before, F.lit(1))), "_head"
    )
    read = heads.select(*keys, F.concat("_head", "_tail").alias("_seen")).withColumn("_vh", F.xxhash64("_seen"))
    return (
        read.join(wanted.select(*scope, "pii_type", "_value", "_vh"), ["_vh", *scope])
        .where((F.length("_seen") == F.length("_value")) & F.contains("_seen", F.col("_value")))
        .select(*keys, "pii_type", F.col("_value").alias("value")).distinct()
    )


def standing_in_documents(
    found: DataFrame, keys: Sequence[str], scope: Sequence[str], text: str = "text", entities: str = "entities",
) -> DataFrame:
    """(keys, text, pii_type, value): the values of a row's ``entities`` that stand in a redacted text of its scope.

    A document of one row is searched within the row; only documents of several are searched by
    ``standing``.  Rows with a null key have no leaks; each of several rows of the same keys has those of all.
    """
    sp.reserve(found, "_g")
    rows = found.withColumn("_g", F.xxhash64(*scope))
    several = stored(rows.groupBy("_g").agg(F.count("*").alias("n")).where("n > 1").select("_g"), "several-blocks")
    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    own = rd.residual(rows.where(named), entities, text, [*keys, text, "_g"]).where(F.col("value") != "")
    alone = own.join(several, "_g", "left_anti").select(*keys, text, "pii_type", "value")
    table, n_words = bloom.words(several, "_g", several.count())
    near = bloom.passing(rows, "_g", stored(table, "several-filter"), n_words)
    among = stored(near.join(several, "_g", "left_semi").select(*keys, text, entities), "blocks-of-several")
    left = standing(among.select(*keys, text), keys, originals(among, scope, entities), scope, text)
    return alone.unionByName(left.join(among.select(*keys, text), list(keys)).select(*keys, text, "pii_type", "value"))


def reason(text: Column, value: Column) -> Column:
    """Why a value's first place in a redacted text was spared.

    amount: a currency mark stands before it, so it counts as an amount; within a word: it is part
    of a longer word or number; unrecognised: no rule fires there.
    """
    at = F.instr(text, value) - 1
    before = sp.before_window(text, at, fv.CURRENCY_WINDOW)
    inside = F.rlike(sp.before_window(text, at, 1), F.lit(WORD)) | F.rlike(
        F.substring(text, at + F.length(value) + 1, F.lit(1)), F.lit(WORD)
    )
    return F.when(v.currency_before(before), "amount").when(inside, "within a word").otherwise("unrecognised")
