"""The detection rules, and detection over a text column.

Each rule is a pair of column functions of the current row: a cheap substring test (the
gate) and the hits.  The gate decides whether the rule's regex runs at all; gates only test
what every match of the rule must contain.  Gates are kept outside of lambdas, and what rules
found is not merged into later steps, so Spark compiles them; lambdas are interpreted, node by
node, and should only run where a gate let a text through.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, normalise as nm, patterns as p, spans as sp, validators as v


@dataclass(frozen=True)
class View:
    """Columns a rule reads: the text, the text to scan, its form with case folded, and
    whether it holds any digit."""

    text: Column
    scan: Column
    folded: Column
    digit: Column

    def has(self, *literals: str) -> Column:
        return _any(F.contains(self.text, F.lit(x)) for x in literals)

    def mentions(self, *words: str) -> Column:
        """Contains one of the words, ignoring case."""
        return _any(F.contains(self.folded, F.lit(p.fold(w))) for w in words)


def _any(tests: Iterable[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return out


Rule = tuple[Column, Column]  # gate, hits


def _tagged(rule: str, gate: Column, hits: Column) -> Column:
    """The spans of a rule; no lambda stands around the gate."""
    return F.when(gate, sp.tag(hits, rule)).otherwise(sp.no_spans())


def _moved(h: Column, value: Column) -> Column:
    """The hit cut at its end to a shorter value."""
    return F.struct(
        h["start"].alias("start"),
        (h["start"] + F.length(value)).alias("end"),
        value.alias("value"),
        h["before"].alias("before"),
    )


def _stripped(h: Column) -> Column:
    """The hit without blanks on either side."""
    body = v.strip(h["value"])
    lead = F.length(h["value"]) - F.length(F.ltrim(h["value"], F.lit(p.BLANK_CHARS)))
    return F.struct(
        (h["start"] + lead).alias("start"),
        (h["start"] + lead + F.length(body)).alias("end"),
        body.alias("value"),
        h["before"].alias("before"),
    )


def email(t: View) -> Rule:
    return t.has("@"), sp.scan(t.scan, p.EMAIL, (1, 2), 1)


def ssn(t: View) -> Rule:
    hits = sp.scan(t.scan, p.SSN)
    return t.digit & t.has("-"), F.filter(hits, lambda h: v.ssn_valid(h["value"]))


def card(t: View) -> Rule:
    hits = sp.scan(t.scan, p.CARD)
    return (
        t.digit & F.rlike(t.text, F.lit(r"\p{Nd}{4}")), F.filter(hits, lambda h: v.luhn_valid(h["value"]))
    )


def ipv4(t: View) -> Rule:
    hits = sp.scan(t.scan, p.IPV4)
    return (
        t.digit & F.rlike(t.text, F.lit(r"[0-9]\.[0-9]{1,3}\.")),
        F.filter(
            hits,
            lambda h: ~v.version_before(sp.last(h["before"], fv.VERSION_WINDOW))
            & v.ipv4_valid(h["value"]),
        ),
    )


def dob(t: View) -> Rule:
    return (
        t.digit & t.mentions("dob", "birth", "born", "d.o.b."), sp.scan(t.scan, p.DOB, (0, 1), 1)
    )


def phone_context(t: View) -> Rule:
    hits = sp.scan(t.scan, p.PHONE_CONTEXT, (0, 1), 1)
    kept = F.filter(
        hits, lambda h: F.length(v.digits_only(h["value"])).between(*fv.PHONE_CONTEXT_DIGITS)
    )
    trimmed = F.transform(kept, lambda h: _moved(h, v.strip_trailing_punctuation(h["value"])))
    return (
        t.digit & t.mentions("tel", "phone", "mob", "fax", "contact"),
        trimmed,
    )


def phone_standalone(t: View) -> Rule:
    hits = sp.scan(t.scan, p.PHONE_STANDALONE)
    kept = F.filter(
        hits,
        lambda h: F.length(v.digits_only(h["value"])).between(*fv.PHONE_STANDALONE_DIGITS)
        & ~v.currency_before(sp.last(h["before"], fv.CURRENCY_WINDOW)),
    )
    gate = t.digit & (t.has("+91") | F.rlike(t.text, F.lit(r"\p{Nd}{6}")))
    return gate, F.transform(kept, _stripped)


def address_context(t: View) -> Rule:
    hits = sp.scan(t.scan, p.ADDRESS_CONTEXT, (0, 1), 1)
    # the only rule whose values can hold the mark character: take them from the text
    trimmed = F.transform(
        hits, lambda h: _moved(h, v.strip_trailing_punctuation(sp.value_at(t.text, h)))
    )
    long_enough = F.filter(
        trimmed, lambda h: F.length(h["value"]) >= fv.ADDRESS_CONTEXT_MIN_LENGTH
    )
    return t.mentions("address", "office"), long_enough


def address_pattern(t: View) -> Rule:
    # hit: from the first thoroughfare word on; before: the run up to that word
    runs = sp.scan(t.scan, p.ADDRESS_RUN, (1, 2, 3), 1)
    with_free = F.transform(
        runs,
        lambda h: F.struct(
            h.alias("run"), F.regexp_extract(h["before"], p.ADDRESS_FREE_END, 0).alias("free")
        ),
    )
    with_number = F.transform(
        with_free,
        lambda a: F.struct(
            a["run"].alias("run"),
            a["free"].alias("free"),
            F.regexp_extract(
                F.regexp_extract(
                    F.substring(
                        a["run"]["before"],
                        F.lit(1),
                        F.length(a["run"]["before"]) - F.length(a["free"]),
                    ),
                    p.ADDRESS_SLASHED_END,
                    0,
                ),
                p.ADDRESS_NUMBER_ON,
                0,
            ).alias("number"),
        ),
    )
    with_lead = F.transform(
        with_number,
        lambda a: F.struct(
            a["run"].alias("run"),
            F.when(a["number"] != "", F.concat(a["number"], a["free"]))
            .when(a["free"] == a["run"]["before"], a["free"])
            .otherwise(F.regexp_replace(a["free"], p.ADDRESS_NON_WORD_START, ""))
            .alias("lead"),
        ),
    )
    whole = F.transform(
        with_lead,
        lambda a: F.struct(
            (a["run"]["start"] - F.length(a["lead"])).alias("start"),
            a["run"]["end"].alias("end"),
            F.concat(a["lead"], a["run"]["value"]).alias("value"),
            a["lead"].alias("before"),
        ),
    )
    cleaned = F.transform(whole, _clean_address)
    long_enough = F.filter(
        cleaned, lambda h: F.length(h["value"]) >= fv.ADDRESS_PATTERN_MIN_LENGTH
    )
    return t.digit & F.rlike(t.text, F.lit(p.PIN)), long_enough


def _clean_address(h: Column) -> Column:
    """Blanks, then contact terms, then closing punctuation come off the end."""
    body = _stripped(h)
    cut = v.drop_contact_terms(body["value"])
    trimmed = v.strip_trailing_punctuation(h["value"])
    return (
        F.when(cut != body["value"], _moved(body, v.strip_trailing_punctuation(cut)))
        .when(trimmed != h["value"], _moved(h, trimmed))
        .otherwise(body)
    )


def company_suffix(t: View) -> Rule:
    hits = F.transform(sp.scan(t.scan, p.COMPANY_SUFFIX, (1, 2), 1), _stripped)
    gate = t.has("Limited", "LIMITED", "Ltd", "LTD", "LLP", "Inc", "INC", "Corp", "CORP")
    return (
        gate & F.rlike(t.text, F.lit(p.COMPANY_SUFFIX_HIT)),
        F.filter(hits, lambda h: v.company_allowed(h["value"])),
    )


def name_salutation(t: View) -> Rule:
    hits = sp.scan(t.scan, p.NAME_SALUTATION, (0, 1), 1)
    return (
        t.has("Mr.", "Ms.", "Mrs.", "Dr.", "Prof.", "Shri", "Smt."),
        F.filter(hits, lambda h: v.name_allowed(h["value"])),
    )


def name_role(t: View) -> Rule:
    hits = sp.scan(t.scan, p.NAME_ROLE, (0, 1), 1)
    return (
        t.mentions("contact", "chairman", "director", "chief", "secretary", "compliance",
                   "promoter", "partner"),
        F.filter(hits, lambda h: v.name_allowed(h["value"])),
    )


def name_phrase(t: View) -> Rule:
    hits = sp.scan(t.scan, p.NAME_PHRASE, (0, 1), 1)
    return (
        t.mentions("namely", "being", "appointed", "designated", "signed", "son", "daughter", "wife"),
        F.filter(hits, lambda h: v.name_allowed(h["value"])),
    )


def name_promoters(t: View) -> Rule:
    lists = sp.scan(t.scan, p.PROMOTER_LIST, (0, 1), 1)
    parts = F.flatten(F.transform(lists, lambda h: F.split(h["value"], p.PROMOTER_SEPARATOR, -1)))
    names = F.filter(
        F.array_distinct(F.transform(parts, v.strip)),
        lambda n: F.size(v.words(n)).between(*fv.PROMOTER_WORDS) & v.not_stop_name(n),
    )
    hits = F.transform(
        names,
        lambda n: F.transform(
            sp.occurrences(t.text, n),
            lambda s: F.struct(
                s.alias("start"), (s + F.length(n)).alias("end"), n.alias("value"), F.lit("").alias("before")
            ),
        ),
    )
    return t.mentions("promoter"), F.flatten(hits)


def clean_terms(terms: Iterable[str | None]) -> tuple[str, ...]:
    """Dictionary terms without nulls, empty ones and repeats, in order."""
    return tuple(sorted({t for t in terms if t}))


def known_values(t: View, entries: Sequence[str]) -> list[Rule]:
    """Every listed value, as a whole word and ignoring case, one gate and scan per value.

    A value that begins or ends with another sign than a letter, digit or underscore has to
    follow, or be followed by, one of these.
    """
    each = []
    for entry in entries:
        first, last = p.is_word(entry[0]), p.is_word(entry[-1])
        pattern = (
            (p.WORD_START if first else r"(?<=[\p{L}\p{N}_])")
            + p.escape(entry)
            + (p.WORD_END if last else r"(?=[\p{L}\p{N}_])")
        )
        each.append((t.mentions(entry), sp.scan(t.scan, "(?iu)" + pattern)))
    return each


TEXT_RULES = {
    "email": email,
    "ssn": ssn,
    "card": card,
    "ipv4": ipv4,
    "dob": dob,
    "phone_context": phone_context,
    "phone_standalone": phone_standalone,
    "address_context": address_context,
    "address_pattern": address_pattern,
    "company_suffix": company_suffix,
    "name_salutation": name_salutation,
    "name_role": name_role,
    "name_phrase": name_phrase,
    "name_promoters": name_promoters,
}

# A dictionary up to this many values is matched value by value inside the row;
# beyond it ``dictionaries.known_spans`` joins instead.
MAX_INLINE_VALUES = 200

_VIEW = ("_text", "_scan", "_folded", "_digit")


def _staged(df: DataFrame, text: str) -> DataFrame:
    """Add the columns of a ``View``, computed once per row."""
    body = F.col(text)
    return df.withColumns(
        {
            "_text": body,
            "_scan": sp.markable(body),
            "_folded": nm.fold(body),
            "_digit": F.rlike(body, F.lit(r"\p{Nd}")),
        }
    )


@lru_cache(maxsize=256)
def _rule_spans(rule: str, known: tuple[str, ...], jvm: object) -> Column:
    """The spans of one rule over the staged columns.  Kept per JVM: such columns
    are plain expressions, and putting them together takes longer than planning."""
    view = View(*[F.col(c) for c in _VIEW])
    parts = known_values(view, known) if known else [TEXT_RULES[rule](view)]
    return F.concat(*[_tagged(rule, *part) for part in parts])


@lru_cache(maxsize=8)
def _resolved(column: str, jvm: object) -> Column:
    return sp.resolved(column)


def _jvm() -> object:
    """The JVM, as a key: held by the caches, so that no later one is taken for it."""
    return SparkContext._jvm


def candidates(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[str] | None = None,
    known_names: Sequence[str] = (),
    known_companies: Sequence[str] = (),
    output: str = "candidates",
) -> DataFrame:
    """Add all spans of the chosen rules, in rule order, overlaps included."""
    known = {"name_known": clean_terms(known_names), "company_known": clean_terms(known_companies)}
    if max(map(len, known.values())) > MAX_INLINE_VALUES:
        raise ValueError(
            f"more than {MAX_INLINE_VALUES} known values: use dictionaries.detect_with_known"
        )
    found = []
    for rule in sp.RULE_ORDER:
        if rules is not None and rule not in rules:
            continue
        if rule in TEXT_RULES:
            found.append(_rule_spans(rule, (), _jvm()))
        elif known[rule]:
            found.append(_rule_spans(rule, known[rule], _jvm()))
    sp.reserve(df, *_VIEW, output)
    spans = F.coalesce(F.concat(*found), sp.no_spans()) if found else sp.no_spans()
    return _staged(df, text).select(*sp.columns(df), spans.alias(output))


def detect(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[str] | None = None,
    known_names: Sequence[str] = (),
    known_companies: Sequence[str] = (),
    output: str = "spans",
) -> DataFrame:
    """Add the resolved, disjoint spans of a text column."""
    sp.reserve(df, output)
    found = candidates(df, text, rules, known_names, known_companies, "_candidates")
    return found.select(*sp.columns(df), _resolved("_candidates", _jvm()).alias(output))


def explode_spans(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span: keys, pii_type, rule, start, end, value."""
    return sp.unnest(df, keys, spans, "s").select(
        *keys,
        F.col("s.pii_type").alias("pii_type"),
        F.col("s.rule").alias("rule"),
        F.col("s.start").cast("long").alias("start"),
        F.col("s.end").cast("long").alias("end"),
        F.col("s.value").alias("value"),
    )
