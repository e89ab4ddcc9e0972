"""Detection with dictionaries of known names and companies of any size.

A short dictionary is matched inside the row.  For a long one, the word sequences of
each text are joined to the entries on equality first, so a text is only searched for
entries whose words it holds; the work does not grow with texts times entries.  Before a word
sequence leaves the row, its first word and the whole of it have passed a Bloom filter of the
entries, so what is shuffled grows with the hits, not with the texts.  The filter is a literal of the plan for
some thousand entries; for more it is a broadcast table, as every step of a plan is written out on the driver, its
literals included, and words are tested in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bloom, normalise as nm, spans as sp
from ..session import stored
from . import detectors

WORD_CHARS = r"\p{L}\p{N}_"
WORD_RUN = rf"[{WORD_CHARS}]+"
BETWEEN_WORDS = rf"[^{WORD_CHARS}]+"
# Up to this many different first words are listed in the plan, more go into a Bloom filter.
MAX_FIRST_WORDS = 1000
# Filters of up to this many entries are literals of the plan (32 KB each), of more broadcast tables.
MAX_ROW_KEYS = 16_384
# Broadcast entries only below this many bytes of text; otherwise the join shuffles.  The driver holds about ten
# times as much, twice.
MAX_BROADCAST_BYTES = 8 * 1024 * 1024
RULE_OF_KIND = {"company": "company_known", "name": "name_known"}


def _folded_words(text: Column) -> Column:
    """The words of a text with case folded."""
    return F.regexp_extract_all(nm.fold(text), F.lit(WORD_RUN), F.lit(0))


def _entries(dictionary: DataFrame) -> DataFrame:
    """The entries (kind, term) without repeats, nulls and empty terms; other kinds are an error."""
    known = F.col("kind").isin(*RULE_OF_KIND)
    checked = F.when(known, F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("no such kind of dictionary entry: "), F.coalesce("kind", F.lit("null"))))
    )
    return (
        dictionary.where(F.col("term").isNotNull() & (F.col("term") != ""))
        .select(checked.alias("kind"), "term")
        .distinct()
    )


class _Firsts:
    """Which words may begin an entry, and which word sequences may be one."""

    def __init__(self, entries: DataFrame):
        named = entries.where(F.col("first_word").isNotNull())
        head = [r[0] for r in named.select("first_word").distinct().limit(MAX_FIRST_WORDS + 1).collect()]
        self.words = head if len(head) <= MAX_FIRST_WORDS else None
        if self.words is None:
            hashes = named.select(F.xxhash64("first_word").alias("first"), F.xxhash64("gram").alias("gram"))
            n = hashes.agg(*[F.approx_count_distinct(c).alias(c) for c in hashes.columns]).first()
            self.first_bits, self.gram_bits = (bloom.build(hashes.select(c).distinct(), c, n[c]) for c in hashes.columns)

    def may_begin(self, word: Column) -> Column:
        return word.isin(*self.words) if self.words is not None else bloom.may_hold(self.first_bits, F.xxhash64(word))

    def may_be(self, gram: Column) -> Column:
        return gram.isNotNull() if self.words is not None else gram.isNotNull() & bloom.may_hold(self.gram_bits, F.xxhash64(gram))


def _sequences(words: str, sizes: Sequence[int], firsts: _Firsts) -> Column:
    """The runs of words, of the given lengths, that may be an entry."""
    places = F.filter(F.transform(words, lambda w, i: F.when(firsts.may_begin(w), i)), lambda i: i.isNotNull())

    def runs(at: Column, w: Column) -> Column:
        return F.array(*[F.when(at + n <= F.size(w), F.array_join(F.slice(w, at + 1, F.lit(n)), " ")) for n in sizes])

    return F.filter(F.flatten(sp.with_each(places, words, runs)), firsts.may_be)


def _in_row(worded: DataFrame, keys: Sequence[str], sizes: Sequence[int], entries: DataFrame) -> DataFrame:
    """``_likely`` for a smaller dictionary, without repeats."""
    firsts = _Firsts(entries)
    worded_sizes = [n for n in sizes if n]
    sequences = [_sequences("_words", worded_sizes, firsts)] if worded_sizes else []
    if 0 in sizes:
        sequences.append(F.regexp_extract_all("_folded", F.lit(BETWEEN_WORDS), F.lit(0)))
    return sp.unnest(
        worded, keys, F.array_distinct(F.concat(*sequences)) if sequences else F.array().cast("array<string>"), "gram"
    )


def _likely(worded: DataFrame, keys: Sequence[str], sizes: Sequence[int], entries: DataFrame, n: int) -> DataFrame:
    """(keys, gram): the runs of words, of the given lengths, that may be one of many entries, repeats included.

    The filters are broadcast tables.  A size of 0 stands for what lies between two words.
    """
    hashed = entries.select(F.xxhash64("first_word").alias("first"), F.xxhash64("gram").alias("whole"), "n_words")
    tables = {}
    for c, keyed in (("first", hashed.where("n_words > 0")), ("whole", hashed)):
        table, size = bloom.words(keyed, c, n)
        tables[c] = stored(table, c + "-filter"), size
    each = worded.select(*keys, "_words", F.posexplode_outer("_words").alias("_place", "_begin")).where(F.col("_begin").isNotNull())
    begun = bloom.passing(each.withColumn("_first", F.xxhash64("_begin")), "_first", *tables["first"])
    runs = [
        F.when(F.col("_place") + m <= F.size("_words"), F.array_join(F.slice("_words", F.col("_place") + 1, F.lit(m)), " ")) for m in sizes if m
    ]
    grams = sp.unnest(begun, keys, F.array(*runs) if runs else F.array().cast("array<string>"), "gram")
    if 0 in sizes:
        between = F.array_distinct(F.regexp_extract_all("_folded", F.lit(BETWEEN_WORDS), F.lit(0)))
        grams = grams.unionByName(sp.unnest(worded, keys, between, "gram"))
    return bloom.passing(grams.withColumn("_whole", F.xxhash64("gram")), "_whole", *tables["whole"]).select(*keys, "gram")


def _entry_pattern(term: Column) -> Column:
    """The whole-word, any-case pattern of an entry."""
    escaped = F.regexp_replace(term, rf"([^{WORD_CHARS}\s])", r"\\$1")
    inside, outside = rf"[{WORD_CHARS}]", rf"[^{WORD_CHARS}]"
    left = F.when(F.rlike(term, F.lit(rf"\A{outside}")), rf"(?<={inside})").otherwise(rf"(?<!{inside})")
    right = F.when(F.rlike(term, F.lit(rf"{outside}\z")), rf"(?={inside})").otherwise(rf"(?!{inside})")
    return F.concat(F.lit("(?iu)"), left, escaped, right)


def keyed_entries(dictionary: DataFrame) -> DataFrame:
    """Entries with the word sequence they are joined on: kind, term, gram, n_words, first_word."""
    return _entries(dictionary).withColumn("_words", _folded_words(F.col("term"))).select(
        "kind",
        "term",
        # an entry without any word has to be all that stands between two words
        F.when(F.size("_words") > 0, F.array_join("_words", " ")).otherwise(nm.fold(F.col("term"))).alias("gram"),
        F.size("_words").alias("n_words"),
        F.get("_words", F.lit(0)).alias("first_word"),
    )


def known_terms(blocks: DataFrame, keys: Sequence[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Per block the entries (kind, term) whose words it holds: keys, terms.

    ``terms`` is array<struct<rule, term, pattern>>, bounded by the length of the block.
    """
    entries = keyed_entries(dictionary)
    shape = entries.agg(
        F.sort_array(F.collect_set("n_words")).alias("sizes"),
        F.sum(F.octet_length("term")).alias("bytes"),
        F.count("*").alias("n"),
    ).first()
    worded = blocks.select(*keys, _folded_words(F.col(text)).alias("_words"), nm.fold(F.col(text)).alias("_folded"))
    if shape.n > MAX_ROW_KEYS:
        entries = stored(entries, "dictionary")
        grams = _likely(worded, keys, shape.sizes, entries, shape.n)
    else:
        grams = _in_row(worded, keys, shape.sizes, entries)
    entries = entries.select("kind", "term", "gram")
    if (shape.bytes or 0) <= MAX_BROADCAST_BYTES:
        entries = F.broadcast(entries)

    rule = F.when(F.col("kind") == "name", RULE_OF_KIND["name"]).otherwise(RULE_OF_KIND["company"])
    return (
        grams.join(entries, "gram")
        .select(*keys, F.struct(rule.alias("rule"), "term", _entry_pattern(F.col("term")).alias("pattern")).alias("t"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("t")).alias("terms"))
    )


def _term_spans(scan: Column, terms: Column) -> Column:
    """Spans of every entry, found as each one's own scan of the text."""
    def spans(t: Column) -> Column:
        name = t["rule"] == RULE_OF_KIND["name"]
        return F.transform(
            sp.scan(scan, t["pattern"]),
            lambda h: F.struct(
                F.when(name, sp.RULE_TYPE["name_known"]).otherwise(sp.RULE_TYPE["company_known"]).alias("pii_type"),
                t["rule"].alias("rule"),
                F.when(name, sp.RULE_ORDER["name_known"]).otherwise(sp.RULE_ORDER["company_known"]).alias("ord"),
                h["start"].alias("start"),
                h["end"].alias("end"),
                h["value"].alias("value"),
            ),
        )

    return F.coalesce(F.flatten(F.transform(terms, spans)), sp.no_spans())


def joined_candidates(
    blocks: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    text: str = "text",
    rules: Sequence[str] | None = None,
    output: str = "candidates",
) -> DataFrame:
    """All spans of the chosen rules and of the dictionary, overlaps included.

    ``keys`` identify a block.  Only keys and entries found are shuffled before the
    join back; with few blocks concerned that join broadcasts them.
    """
    sp.reserve(blocks, "terms", "_scan", "_text_spans", output)
    terms = known_terms(blocks, keys, dictionary, text)
    found = detectors.candidates(blocks.join(terms, list(keys), "left"), text, rules, output="_text_spans")
    chosen = F.col("terms") if rules is None else F.filter("terms", lambda t: t["rule"].isin(*rules))
    return (
        found.withColumn("_scan", sp.markable(F.col(text)))
        .withColumn(output, F.concat("_text_spans", _term_spans(F.col("_scan"), chosen)))
        .drop("_text_spans", "_scan", "terms")
    )


def detect_with_known(
    blocks: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    text: str = "text",
    rules: Sequence[str] | None = None,
    output: str = "spans",
    max_inline: int = detectors.MAX_INLINE_VALUES,
) -> DataFrame:
    """Detection with a dictionary DataFrame (kind name | company, term).

    A dictionary of up to ``max_inline`` entries is matched in the row, a longer one joined; the
    spans are the same.
    """
    head = _entries(dictionary).limit(max_inline + 1).collect()
    if len(head) <= max_inline:
        return detectors.detect(
            blocks,
            text,
            rules,
            known_names=[r.term for r in head if r.kind == "name"],
            known_companies=[r.term for r in head if r.kind == "company"],
            output=output,
        )
    return (
        joined_candidates(blocks, keys, dictionary, text, rules, "_candidates")
        .withColumn(output, sp.resolved("_candidates"))
        .drop("_candidates")
    )
