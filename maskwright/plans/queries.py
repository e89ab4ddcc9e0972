"""Registered queries: every operator over the given tables.

Each takes ``(spark, folder)`` and returns a DataFrame.  ``check_queries.py`` holds the
SQL of the same name.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv, normalise as nm, patterns as p, spans as sp, surrogates as su, validators as v
from ..operators import assigned as asg
from ..operators import blocks as bl, detectors as dt, dictionaries as dc, evaluate as ev, redact as rd
from ..operators import residual as rl
from ..operators import runs as rn
from ..session import dealt_texts, shared_folder, spread, stored
from ..sources import fixtures as fx
from ..sources import readers as rs
from ..streaming import redaction as st

KEYS = ["source", "doc_id", "block_id"]
KNOWN = {"known_names": fx.KNOWN_NAMES, "known_companies": fx.KNOWN_COMPANIES}


# --- inputs ------------------------------------------------------------------------------


def text_table(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return spread(dealt_texts(rs.text_blocks(spark, folder, names)), *KEYS)


def fixture_texts(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    out = None
    for name in names or fx.TEXTS:
        part = fx.run_sql(spark, folder, fx.TEXTS[name][0]).select(
            F.lit(name).alias("source"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.lit(0).cast("long").alias("block_id"),
            "text",
        )
        out = part if out is None else out.unionByName(part)
    return out


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All texts: the three text tables and the derived ones."""
    texts = dealt_texts(rs.text_blocks(spark, folder))
    return spread(texts.unionByName(fixture_texts(spark, folder)), *KEYS)


def corpus_entities(spark: SparkSession, folder: str) -> DataFrame:
    return rd.with_entities(corpus(spark, folder), salt=fx.SALT, **KNOWN)


# --- sources and blocks --------------------------------------------------------------------


def scan_blocks(spark, folder):
    return rs.text_blocks(spark, folder)


def blocks_line(spark, folder):
    """The lines of all text tables."""
    out = bl.lines(rs.text_blocks(spark, folder).withColumnRenamed("block_id", "unit"), ["source", "doc_id", "unit"])
    return out.withColumn("block_id", F.col("block_id").cast("long"))


def _tables(spark, folder):
    """A table per supplier: two rows, a cell of two lines, and a nested table."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    plain = "array<struct<cells:array<string>>>"
    cell = lambda text, nested: F.struct(text.alias("text"), nested.cast(plain).alias("nested"))
    inner = F.array(
        F.struct(F.array(F.lit("label"), F.concat(F.lit("ask s"), key, F.lit("@mail.example.org"))).alias("cells"))
    )
    rows = F.array(
        F.struct(F.array(cell(F.lit("Crate"), F.array()), cell(F.lit("Contents"), F.array())).alias("cells")),
        F.struct(
            F.array(
                cell(F.concat(F.lit("Keeper\n"), name), F.array()),
                cell(F.concat(F.lit("m"), key, F.lit("@mail.example.org")), inner),
            ).alias("cells")
        ),
    )
    return rs.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), rows.alias("rows"))


def blocks_table_cells(spark, folder):
    return bl.table_cells(_tables(spark, folder), ["doc_id"]).select(
        "doc_id", F.array_join(F.transform("path", lambda i: i.cast("string")), "/").alias("path"), "text"
    )


def blocks_nested_cells(spark, folder):
    """Tables in cells of tables, none to six deep, one chain for each customer."""
    out = bl.nested_cells(fx.run_sql(spark, folder, fx.NESTED_CELLS), max_depth=6)
    return out.select(
        "doc_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda i: i.cast("string")), "/").alias("path"),
        F.col("line").cast("long").alias("line"), "text",
    )


def blocks_sections(spark, folder):
    """Body, header and footer per customer; some have no header."""
    key = F.col("c_custkey").cast("string")
    docs = rs.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("long").alias("doc_id"),
        F.array(F.col("c_name"), F.concat(F.lit("segment "), F.col("c_mktsegment"))).alias("body"),
        F.when(F.col("c_custkey") % 3 > 0, F.array(F.concat(F.lit("head "), key))).alias("header"),
        F.array(F.concat(F.lit("foot "), key), F.lit(None).cast("string")).alias("footer"),
    )
    return bl.sections(docs, ["doc_id"]).withColumn("block_id", F.col("block_id").cast("long"))


PART_KEYS = ["doc_id", "section", "place"]


def _parts(spark, folder):
    return fx.run_sql(spark, folder, fx.PARTS).withColumn("doc_id", F.col("doc_id").cast("long"))


def blocks_parts(spark, folder):
    """Paragraphs and nested table cells of bodies, headers and footers; damaged parts are left out."""
    read = stored(bl.parts(_parts(spark, folder), ["doc_id"]), "parts")  # read by paragraphs, outer and inner cells
    return bl.part_blocks(read, ["doc_id"])


def blocks_part_faults(spark, folder):
    return bl.part_faults(bl.parts(_parts(spark, folder), ["doc_id"]), ["doc_id"])


def document_run(spark, folder):
    """Documents in parts, read, taken once, redacted."""
    return rd.document_run(_parts(spark, folder), ["doc_id"], fx.SALT)[0]


def document_run_summary(spark, folder):
    return rd.document_run(_parts(spark, folder), ["doc_id"], fx.SALT)[1]


def dedup_blocks(spark, folder):
    return bl.dedup(fx.run_sql(spark, folder, fx.DUP_BLOCKS))


def nonblank_blocks(spark, folder):
    lines = bl.lines(
        text_table(spark, folder, *rs.TEXT_TABLES).withColumnRenamed("block_id", "unit"),
        ["source", "doc_id", "unit"],
    )
    return bl.nonblank(lines).withColumn("block_id", F.col("block_id").cast("long"))


# --- detection -------------------------------------------------------------------------------


def _detect_rule(spark, folder, rule):
    found = dt.candidates(corpus(spark, folder), rules=[rule], **KNOWN)
    return dt.explode_spans(found, KEYS, "candidates")


def all_candidates(spark, folder):
    return dt.explode_spans(dt.candidates(corpus(spark, folder), **KNOWN), KEYS, "candidates")


def resolve_spans(spark, folder):
    return dt.explode_spans(dt.detect(corpus(spark, folder), **KNOWN), KEYS)


def detect_known_joined(spark, folder):
    """Known names and firms through the join used for long dictionaries."""
    dictionary = spark.createDataFrame(
        [("name", n) for n in fx.KNOWN_NAMES] + [("company", c) for c in fx.KNOWN_COMPANIES],
        "kind string, term string",
    )
    found = dc.joined_candidates(corpus(spark, folder), KEYS, dictionary, rules=["name_known", "company_known"])
    return dt.explode_spans(found, KEYS, "candidates").drop("pii_type")


def detect_known_derived(spark, folder):
    """Names and firms derived from the keys of customers and suppliers, found in letters on orders.

    The dictionary grows with the tables; beyond 1,000 first words it is a Bloom filter in the row.
    """
    dictionary = fx.run_sql(spark, folder, fx.LETTER_TERMS)
    letters = fx.run_sql(spark, folder, fx.LETTERS).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = dc.detect_with_known(spread(letters, "doc_id"), ["doc_id"], dictionary, rules=["name_known", "company_known"], max_inline=0)
    return dt.explode_spans(found, ["doc_id"]).drop("pii_type")


LINES_OF_UNIT = 1_000_000_000  # line numbers of one unit lie below this


def detect_distinct_blocks(spark, folder):
    """Detection once per distinct line of all text tables, joined back to every line."""
    units = text_table(spark, folder, *rs.TEXT_TABLES).withColumnRenamed("block_id", "unit")
    lines = bl.nonblank(bl.lines(units, ["source", "doc_id", "unit"])).withColumn(
        "block_id", F.col("unit") * LINES_OF_UNIT + F.col("block_id")
    )
    return bl.detect_distinct(lines, KEYS, **KNOWN)


def _hits(spark, folder, pattern, groups=(0,), hit=0, gate=None):
    """Bare matches of a pattern; ``gate`` is a cheaper pattern that every match contains."""
    texts = corpus(spark, folder)
    if gate is not None:
        texts = texts.where(F.rlike("text", F.lit(gate)))
    staged = texts.withColumn("_scan", sp.markable(F.col("text")))
    hits = sp.scan(F.col("_scan"), pattern, groups, hit)
    return sp.unnest(staged, [*KEYS, "text"], hits, "h").select(
        *KEYS, "text", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.value").alias("value")
    )


def _shown(df, *extra):
    return df.select(
        *KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", *extra
    )


LONG_NUMBER = r"[0-9](?:[ -]?[0-9]){12,18}"


def luhn_valid(spark, folder):
    return _shown(_hits(spark, folder, LONG_NUMBER), v.luhn_valid(F.col("value")).alias("is_valid"))


def ssn_valid(spark, folder):
    return _shown(
        _hits(spark, folder, r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), v.ssn_valid(F.col("value")).alias("is_valid")
    )


def ipv4_valid(spark, folder):
    return _shown(
        _hits(spark, folder, r"[0-9]{1,4}(?:\.[0-9]{1,4})+"), v.ipv4_valid(F.col("value")).alias("is_valid")
    )


def phone_digit_filter(spark, folder):
    n = F.length(v.digits_only(F.col("value"))).cast("long")
    return _shown(
        _hits(spark, folder, p.PHONE_CONTEXT, (0, 1), 1),
        n.alias("n_digits"),
        n.between(*fv.PHONE_CONTEXT_DIGITS).alias("labelled"),
        n.between(*fv.PHONE_STANDALONE_DIGITS).alias("standalone"),
    )


def guard_currency(spark, folder):
    window = sp.before_window(F.col("text"), F.col("start"), fv.CURRENCY_WINDOW)
    return _shown(
        _hits(spark, folder, p.PHONE_STANDALONE), window.alias("before"), v.currency_before(window).alias("is_amount")
    )


def guard_version(spark, folder):
    window = sp.before_window(F.col("text"), F.col("start"), fv.VERSION_WINDOW)
    return _shown(_hits(spark, folder, p.IPV4), window.alias("before"), v.version_before(window).alias("is_version"))


def trim_spans(spark, folder):
    trimmed = v.strip_trailing_punctuation(F.col("value"))
    return _shown(
        _hits(spark, folder, p.PHONE_CONTEXT, (0, 1), 1),
        trimmed.alias("trimmed"),
        (F.col("start") + F.length(trimmed)).cast("long").alias("trimmed_end"),
        v.drop_contact_terms(v.strip(F.concat("value", F.lit(" Tel Contact")))).alias("without_terms"),
    )


def _company_hits(spark, folder):
    return _hits(spark, folder, p.COMPANY_SUFFIX, (1, 2), 1, gate=p.COMPANY_SUFFIX_HIT).withColumn("value", v.strip(F.col("value"))).select(
        *KEYS, F.col("end").cast("long").alias("end"), "value"
    )


def stop_company(spark, folder):
    """Suffix hits that are no stop phrase, by an anti join with the fixed list."""
    stops = spark.createDataFrame([(s,) for s in fv.COMPANY_STOPS], "value string")
    return _company_hits(spark, folder).join(F.broadcast(stops), "value", "left_anti").select(*KEYS, "end", "value")


def company_prefix_rules(spark, folder):
    value = F.col("value")
    return _company_hits(spark, folder).select(
        *KEYS,
        "end",
        "value",
        (value.startswith(fv.COMPANY_BAD_PREFIXES[0]) | value.startswith(fv.COMPANY_BAD_PREFIXES[1])).alias("is_statute"),
        (value.startswith("The ") & (F.size(v.words(value)) == 2)).alias("is_bare"),
        v.company_allowed(value).alias("allowed"),
    )


def name_guards(spark, folder):
    value = F.col("value")
    return _shown(
        _hits(spark, folder, p.NAME_ROLE, (0, 1), 1),
        v.not_stop_name(value).alias("not_stop"),
        v.name_allowed(value).alias("allowed"),
    )


# --- keys, surrogates, redaction ------------------------------------------------------------


def _entities(spark, folder):
    return rd.explode_entities(corpus_entities(spark, folder), KEYS)


def normalize_keys(spark, folder):
    return _entities(spark, folder).select("pii_type", "value", "key").distinct()


def _surrogate(spark, folder, pii_type):
    rules = [r for r, t in fv.RULES if t == pii_type]
    found = rd.with_entities(corpus(spark, folder), salt=fx.SALT, rules=rules, **KNOWN)
    return rd.mapping(found).select("normalized_original", "synthetic_replacement")


def mapping_audit(spark, folder):
    return rd.mapping(corpus_entities(spark, folder))


def mapping_total(spark, folder):
    return rd.mapping_report(mapping_audit(spark, folder))


def mapping_consistency(spark, folder):
    """Per category: keys, and the most replacements any key got."""
    per_key = (
        rd.mapping(corpus_entities(spark, folder))
        .groupBy("pii_type", "normalized_original")
        .agg(F.count("*").alias("n"))
    )
    return per_key.groupBy("pii_type").agg(F.count("*").alias("n_keys"), F.max("n").alias("most_replacements"))


def redact_documents(spark, folder):
    """The flagship: documents with all their sensitive values replaced."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    return rd.redact_text(docs, salt=fx.SALT)


def redact_corpus(spark, folder):
    return rd.redact_text(corpus(spark, folder), salt=fx.SALT, **KNOWN)


def redaction_counts(spark, folder):
    return rd.counts(corpus_entities(spark, folder))


def run_summary(spark, folder):
    return rd.run_summary(corpus_entities(spark, folder))


def block_redaction_count(spark, folder):
    """Replacements per line of the documents; blank lines have none."""
    lines = bl.lines(text_table(spark, folder, "documents").drop("block_id"), ["source", "doc_id"])
    return dt.detect(lines).select(
        "doc_id", F.col("block_id").cast("long").alias("block_id"), F.size("spans").cast("long").alias("n_redactions")
    )


def residual_leaks(spark, folder):
    found = corpus_entities(spark, folder)
    after = found.withColumn("redacted", sp.splice(F.col("text"), F.col("entities"), lambda e: e["replacement"]))
    return rd.residual(after, "entities", "redacted", KEYS)


def mapping_assigned(spark, folder):
    """Every key with a replacement that no other key of its type has."""
    found = _entities(spark, folder).select("pii_type", "key")
    return asg.assigned(found, fx.SALT).select(
        "pii_type", F.col("key").alias("normalized_original"), F.col("replacement").alias("synthetic_replacement")
    )


def redact_corpus_assigned(spark, folder):
    found = stored(corpus_entities(spark, folder).select(*KEYS, "text", "entities"), "entities")
    return asg.redact(found, KEYS, fx.SALT).drop("entities")


def _redacted_corpus(spark, folder):
    """The texts after redaction with the values found in each, written in one pass."""
    values = F.array_distinct(F.transform("entities", lambda e: F.struct(e["pii_type"].alias("pii_type"), e["value"].alias("value"))))
    redacted = sp.splice(F.col("text"), F.col("entities"), lambda e: e["replacement"])
    return stored(corpus_entities(spark, folder).select(*KEYS, redacted.alias("text"), values.alias("entities")), "redacted")


def residual_leaks_document(spark, folder):
    """Originals of a document that still stand in any of its blocks, and why."""
    return rl.standing_in_documents(_redacted_corpus(spark, folder), KEYS, KEYS[:2]).select(
        *KEYS, "pii_type", "value", rl.reason(F.col("text"), F.col("value")).alias("reason")
    )


def residual_leaks_corpus(spark, folder):
    """Originals that still stand anywhere in the corpus, with the blocks that hold them."""
    redacted = _redacted_corpus(spark, folder)
    left = rl.standing(redacted.select(*KEYS, "text"), KEYS, rl.originals(redacted))
    return left.groupBy("pii_type", "value").agg(F.count("*").alias("n_blocks"))


# --- styled runs -----------------------------------------------------------------------------


def _runs(spark, folder, sql):
    """Blocks with their runs; the runs of one block are few."""
    flat = fx.run_sql(spark, folder, sql)
    return (
        flat.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.sort_array(F.collect_list(F.struct("run_id", "text", "bold", "italic"))).alias("runs"))
    )


def _redacted_runs(spark, folder, sql):
    return rn.redact_runs(rd.with_entities(rn.with_text(_runs(spark, folder, sql)), salt=fx.SALT))


def _run_rows(df):
    return rn.explode_runs(df, ["doc_id"]).withColumn("run_id", F.col("run_id").cast("long"))


def redact_runs_single(spark, folder):
    return _run_rows(_redacted_runs(spark, folder, fx.SINGLE_RUNS))


def redact_runs_multi(spark, folder):
    return _run_rows(_redacted_runs(spark, folder, fx.RUNS))


def span_run_overlap(spark, folder):
    return rn.span_runs(rd.with_entities(rn.with_text(_runs(spark, folder, fx.RUNS)), salt=fx.SALT), ["doc_id"])


def run_offsets(spark, folder):
    placed = sp.unnest(_runs(spark, folder, fx.RUNS), ["doc_id"], rn.run_offsets(F.col("runs")), "r")
    return placed.select(
        "doc_id", *[F.col("r." + c).cast("long").alias(c) for c in ("run_id", "start", "end")]
    )


def layout_preserved(spark, folder):
    before = rn.layout(_runs(spark, folder, fx.RUNS)).withColumn("state", F.lit("before"))
    after = rn.layout(_redacted_runs(spark, folder, fx.RUNS)).withColumn("state", F.lit("after"))
    return before.unionByName(after)


# --- evaluation --------------------------------------------------------------------------------


def _cases(spark, folder):
    return dt.detect(
        fx.run_sql(spark, folder, fx.CASES).withColumn("expected", F.array("expected"))
    )


def _negatives(spark, folder):
    return dt.detect(fx.run_sql(spark, folder, fx.NEGATIVES))


def _passages(spark, folder):
    """Labelled passages; labels of one passage are few."""
    labels = fx.run_sql(spark, folder, fx.TRUTH).groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("truth_idx", F.col("pii_type").alias("type"), "value"))).alias("labels")
    )
    texts = fixture_texts(spark, folder, "fx_contacts").select(F.col("doc_id").alias("passage_id"), "text")
    return texts.join(labels, "passage_id", "left").select(
        "passage_id",
        "text",
        F.transform("labels", lambda t: F.struct(t["type"].alias("type"), t["value"].alias("value"))).alias("truth"),
    )


def _matched(spark, folder):
    return ev.match_passages(dt.detect(_passages(spark, folder)))


def truth_rows(spark, folder):
    return rs.truth_rows(_passages(spark, folder)).withColumn("passage_id", F.col("passage_id").cast("long"))


def _label_lines(spark, folder):
    """Labels of customers' passages as JSON lines in the shared folder, every seventh line cut short; none of a missing path."""
    place = shared_folder(spark, "labels-json")
    labels = fx.run_sql(spark, folder, fx.TRUTH).groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("truth_idx", F.col("pii_type").alias("type"), "value"))).alias("t")
    )
    key = F.col("passage_id")
    source = F.when(key % 3 > 0, F.concat(F.lit("shelf "), key.cast("string")))
    passage = F.struct(
        F.when(key % 4 > 0, F.concat(F.lit("text "), key.cast("string"))).alias("text"),
        F.transform("t", lambda t: F.struct(t["type"].alias("type"), t["value"].alias("value"))).alias("ground_truth_pii"),
    )
    whole = F.to_json(F.struct(key.cast("string").alias("id"), F.struct(source.alias("source")).alias("metadata"), F.array(passage).alias("passages")))
    lines = labels.select(F.when(key % 7 == 3, F.substring(whole, 1, 12)).otherwise(whole).alias("value"))
    lines.write.text(place + "/in")
    return rs.label_lines(spark, place + "/in").unionByName(rs.label_lines(spark, place + "/missing"))


def labels_json(spark, folder):
    """Labels read back from JSON of changing shape."""
    found = rs.labelled_passages(_label_lines(spark, folder))
    return found.select("source", "text", F.explode("truth").alias("t")).select("source", "text", F.col("t.type").alias("pii_type"), F.col("t.value").alias("value"))


def labels_damaged(spark, folder):
    return rs.damaged_lines(_label_lines(spark, folder)).select("raw")


def evaluation_full(spark, folder):
    """Both tiers: categories, tiers and all from one grouped pass, with accuracy and texts."""
    cases = fx.run_sql(spark, folder, fx.CASES).withColumn("expected", F.array("expected"))
    return ev.full_run(cases, fx.run_sql(spark, folder, fx.NEGATIVES), _passages(spark, folder), su.DEFAULT_AS_OF)


def eval_cases(spark, folder):
    return ev.score_cases(_cases(spark, folder))


def eval_negatives(spark, folder):
    return ev.score_negatives(_negatives(spark, folder))


def normalize_match_text(spark, folder):
    return fx.run_sql(spark, folder, fx.TRUTH).select(
        F.col("passage_id").cast("long").alias("passage_id"),
        F.col("truth_idx").cast("long").alias("truth_idx"),
        "value",
        nm.match_text(F.col("value")).alias("normalised"),
    )


def match_values(spark, folder):
    """Every detection of the labelled passages against every label of its type."""
    found = dt.explode_spans(dt.detect(_passages(spark, folder)), ["passage_id"])
    labels = rs.truth_rows(_passages(spark, folder)).withColumnRenamed("value", "label")
    return found.join(labels, ["passage_id", "pii_type"]).select(
        "passage_id", "start", "value", "truth_idx", "label",
        ev.values_match(F.col("value"), F.col("label")).alias("is_match"),
    )


def eval_passages(spark, folder):
    """Which label each detection takes, -1 if none."""
    return _matched(spark, folder).select(
        "passage_id", F.posexplode_outer(F.arrays_zip("spans", "matched")).alias("i", "m")
    ).where(F.col("i").isNotNull()).select(
        "passage_id",
        F.col("i").cast("long").alias("prediction"),
        F.col("m.spans.pii_type").alias("pii_type"),
        F.col("m.spans.value").alias("value"),
        F.col("m.matched").cast("long").alias("truth_idx"),
    )


def _passage_metrics(spark, folder):
    return ev.passage_metrics(dt.detect(_passages(spark, folder)))


def metrics_per_type(spark, folder):
    return ev.rounded(_passage_metrics(spark, folder))


def metrics_micro_macro(spark, folder):
    return ev.averages(_passage_metrics(spark, folder))


def binary_accuracy(spark, folder):
    return ev.binary_accuracy(
        ev.score_cases(_cases(spark, folder)),
        ev.score_negatives(_negatives(spark, folder)),
        fx.run_sql(spark, folder, fx.CASES),
        fx.run_sql(spark, folder, fx.NEGATIVES),
    )


def eval_report(spark, folder):
    return ev.report(_passage_metrics(spark, folder))


def evaluation_run(spark, folder):
    """Both tiers: labelled cases with negatives, and labelled passages."""
    cases = fx.run_sql(spark, folder, fx.CASES).withColumn("expected", F.array("expected"))
    return ev.run(cases, fx.run_sql(spark, folder, fx.NEGATIVES), _passages(spark, folder))


# --- streams -------------------------------------------------------------------------------------


def stream_redact(spark, folder):
    """The documents as a stream, redacted into parquet, and that parquet read back."""
    stream = st.read_table(spark, folder, "documents").select("doc_id", "text")
    place = shared_folder(spark, "stream-redact")
    st.run_available(st.redact_stream(stream, salt=fx.SALT), place + "/out", place + "/state")
    return spark.read.parquet(place + "/out")


def _event_texts(spark, folder):
    stream = st.read_table(spark, folder, "events")
    text = F.concat(
        F.lit("host 10."), (F.col("event_id") % 300).cast("string"), F.lit(".0."),
        (F.col("user_id") % 256).cast("string"), F.lit(" mail u"), F.col("user_id").cast("string"), F.lit("@mail.example.org"),
    )
    return stream.select(F.col("event_id").cast("long").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"))


def stream_dedup(spark, folder):
    """Events that come one to three times, each kept once."""
    copies = F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))
    stream = _event_texts(spark, folder).withColumn("copy", F.explode(copies)).drop("copy")
    place = shared_folder(spark, "stream-dedup")
    st.run_available(st.dedup_stream(stream, ["doc_id"], "ts"), place + "/out", place + "/state")
    return spark.read.parquet(place + "/out").select("doc_id", "text")


def stream_mapping(spark, folder):
    """The mapping of all events' texts, written by a stream."""
    place = shared_folder(spark, "stream-mapping")
    st.run_available(st.mapping_stream(_event_texts(spark, folder), salt=fx.SALT), place + "/out", place + "/state")
    return spark.read.parquet(place + "/out")


def stream_counts(spark, folder):
    """Detections per category and hour of event time, closed windows only."""
    stream = st.read_table(spark, folder, "events")
    texts = stream.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("host 10."), (F.col("event_id") % 300).cast("string"), F.lit(".0."),
            (F.col("user_id") % 256).cast("string"), F.lit(" mail u"), F.col("user_id").cast("string"),
            F.lit("@mail.example.org"),
        ).alias("text"),
    )
    place = shared_folder(spark, "stream-counts")
    counted = st.counts_stream(texts, "ts", rules=["email", "ipv4"])
    st.run_available(counted, place + "/out", place + "/state")
    return spark.read.parquet(place + "/out").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_blocks, blocks_line, blocks_table_cells, blocks_nested_cells, blocks_sections, dedup_blocks, nonblank_blocks, truth_rows,
        blocks_parts, blocks_part_faults, document_run, document_run_summary,
        all_candidates, resolve_spans, detect_known_joined, detect_known_derived, detect_distinct_blocks,
        luhn_valid, ssn_valid, ipv4_valid, phone_digit_filter, guard_currency, guard_version, trim_spans,
        stop_company, company_prefix_rules, name_guards, normalize_keys, normalize_match_text,
        mapping_audit, mapping_total, mapping_consistency, redact_documents, redact_corpus, redaction_counts,
        run_summary, block_redaction_count, residual_leaks, residual_leaks_document, residual_leaks_corpus,
        mapping_assigned, redact_corpus_assigned,
        redact_runs_single, redact_runs_multi, span_run_overlap, run_offsets, layout_preserved,
        eval_cases, eval_negatives, match_values, eval_passages, metrics_per_type, metrics_micro_macro,
        binary_accuracy, eval_report, evaluation_run, evaluation_full, labels_json, labels_damaged,
        stream_redact, stream_counts, stream_dedup, stream_mapping,
    )
}
QUERIES.update({f"detect_{rule}": partial(_detect_rule, rule=rule) for rule, _ in fv.RULES})
SURROGATES = {
    "name": "FULL_NAME", "email": "EMAIL", "phone": "PHONE", "company": "COMPANY", "address": "ADDRESS",
    "ssn": "SSN", "card": "CREDIT_CARD", "dob": "DOB", "ipv4": "IP_ADDRESS",
}
QUERIES.update(
    {f"surrogate_{short}": partial(_surrogate, pii_type=kind) for short, kind in SURROGATES.items()}
)
