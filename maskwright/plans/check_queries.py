"""The SQL of every registered query (see ``checks.py`` for the parts)."""

from __future__ import annotations

from ..functions import fixed_values as fv, patterns as p
from ..sources import fixtures as fx
from . import checks as ck
from .checks import KEYS, SPAN_COLUMNS, candidate_ctes, entity_ctes, q, recursive, resolved_ctes, strip
from .queries import LINES_OF_UNIT, LONG_NUMBER, SURROGATES

_LINES = """select {keys}, unnest(generate_series(0, len(l) - 1))::bigint as block_id, unnest(l) as text
from (select *, string_split(text, chr(10)) as l from ({source}))"""

_DOC_LINES = _LINES.format(keys="source, doc_id", source=ck.tables_sql(["documents"]))
# the lines of all text tables, numbered below their unit
_ALL_LINES = (
    f"select source, doc_id, unit * {LINES_OF_UNIT} + block_id as block_id, text from ("
    + _LINES.format(keys="source, doc_id, unit", source="select source, doc_id, block_id as unit, text from (" + ck.tables_sql() + ")")
    + ")"
)


def _spans(body_ctes: str, name: str) -> str:
    return recursive(body_ctes, f"select {SPAN_COLUMNS} from {name}")


def _raw_hits(rule_or_pattern, columns: str) -> str:
    pattern, group = rule_or_pattern if isinstance(rule_or_pattern, tuple) else ck.p.RE2[rule_or_pattern]
    return ck.with_corpus(
        f'select {KEYS}, s::bigint as "start", e::bigint as "end", f as value, {columns} '
        f"from ({ck._hits(pattern, group)})"
    )


def _company_hits(columns: str, where: str = "true") -> str:
    return ck.with_corpus(
        f"select {KEYS}, \"end\", value{columns} from (select {KEYS}, {strip('f')} as value, e::bigint as \"end\" "
        f"from ({ck._hits(*ck.p.RE2['company_suffix'])})) where {where}"
    )


def _without_terms() -> str:
    level = f"select *, {strip('f || ' + q(' Tel Contact'))} as c0 from ({ck._hits(*ck.p.RE2['phone_context'])})"
    for i, term in enumerate(fv.CONTACT_TERMS):
        cut = strip(f"left(c{i}, length(c{i}) - {len(term)})")
        level = f"select *, case when ends_with(c{i}, {q(term)}) then {cut} else c{i} end as c{i + 1} from ({level})"
    trimmed = ck.rstrip_marks("f")
    return ck.with_corpus(
        f'select {KEYS}, s::bigint as "start", e::bigint as "end", f as value, {trimmed} as trimmed, '
        f"(s + length({trimmed}))::bigint as trimmed_end, c{len(fv.CONTACT_TERMS)} as without_terms from ({level})"
    )


_PART_BLOCKS = f"""select c_custkey::bigint as doc_id, section, place, text from customer, lateral (values
  ('body', '0', 'Contact Person: ' || {fx.first_name()} || ' ' || {fx.last_name()}), ('body', '1', ' '),
  ('body', 't/0/2/0', 'mail u' || c_custkey || '@mail.example.org'), ('body', 't/0/2/1/0/0', 'host 10.1.2.' || (c_custkey % 250)),
  ('header', '0', case when c_custkey % 4 = 3 then 'head ' || c_custkey end),
  ('footer', 't/' || (c_custkey % 3) || '/0/0', 'SSN 321-45-' || lpad((c_custkey % 9000 + 1)::varchar, 4, '0'))) t(section, place, text)
where text is not null"""
# sections and places stand in for sources and blocks
_PART_TEXTS = f"select section || '|' || place as source, doc_id, 0::bigint as block_id, text from ({_PART_BLOCKS}) where {strip('text')} <> ''"

CHECKS = {
    "blocks_parts": _PART_BLOCKS,
    "blocks_part_faults": """select c_custkey::bigint as doc_id, 'header' as section,
  case c_custkey % 4 when 1 then '{' || chr(34) || 'paragraphs' || chr(34) || ':[' else '[7]' end as raw
from customer where c_custkey % 4 in (1, 2)""",
    "document_run": recursive(
        f"{entity_ctes(_PART_TEXTS, known=False)}, {ck.REDACTED}",
        "select doc_id, split_part(source, '|', 1) as section, split_part(source, '|', 2) as place, text, n_redactions from redacted",
    ),
    "document_run_summary": recursive(
        entity_ctes(_PART_TEXTS, known=False),
        "select count(*) as total_redactions, count(distinct (pii_type, key)) as unique_entities, "
        + ", ".join(f"count(*) filter (pii_type = '{c}') as n_{c.lower()}" for c in fv.CATEGORIES)
        + " from entities",
    ),
    "scan_blocks": ck.tables_sql(),
    "blocks_line": _LINES.format(keys="source, doc_id, unit", source="select source, doc_id, block_id as unit, text from (" + ck.tables_sql() + ")"),
    "blocks_table_cells": """
select s_suppkey::bigint as doc_id, path, text from supplier, lateral (values
  ('0/0/0', 'Crate'), ('0/1/0', 'Contents'), ('1/0/0', 'Keeper'), ('1/0/1', s_name),
  ('1/1/0', 'm' || s_suppkey || '@mail.example.org'), ('1/1/0/0/0', 'label'),
  ('1/1/0/1/0', 'ask s' || s_suppkey || '@mail.example.org')) t(path, text)""",
    "blocks_nested_cells": f"""with recursive cells as materialized ({fx.plain(fx.NESTED_CELLS)}),
walk as (select doc_id, cell_id, 0 as depth, row || '/' || col as path, text from cells where parent_id is null
  union all select c.doc_id, c.cell_id, depth + 1, path || '/' || row || '/' || col, c.text
  from walk w join cells c on c.doc_id = w.doc_id and c.parent_id = w.cell_id)
select doc_id::bigint as doc_id, depth::bigint as depth, path, unnest(generate_series(0, len(l) - 1))::bigint as line, unnest(l) as text
from (select *, string_split(text, chr(10)) as l from walk)""",
    "blocks_sections": """
select c_custkey::bigint as doc_id, 'body' as section, 0::bigint as block_id, c_name as text from customer
union all select c_custkey, 'body', 1, 'segment ' || c_mktsegment from customer
union all select c_custkey, 'header', 0, 'head ' || c_custkey from customer where c_custkey % 3 > 0
union all select c_custkey, 'footer', 0, 'foot ' || c_custkey from customer""",
    "dedup_blocks": """
select distinct l_orderkey::bigint as doc_id, l_linenumber::bigint as block_id,
  'cell ' || l_orderkey || '/' || l_linenumber as text from lineitem""",
    "nonblank_blocks": f"""select source, doc_id, unit, block_id, text from (
select source, doc_id, unit, unnest(generate_series(0, len(l) - 1))::bigint as block_id, unnest(l) as text
from (select source, doc_id, block_id as unit, string_split(text, chr(10)) as l from ({ck.tables_sql()})))
where {strip('text')} <> ''""",
    "all_candidates": _spans(candidate_ctes(), "candidates"),
    "resolve_spans": _spans(resolved_ctes(), "spans"),
    "detect_known_joined": ck.with_corpus(
        f'select {KEYS}, rule, "start", "end", value from '
        f"({ck.rule_sql('name_known')} union all {ck.rule_sql('company_known')})"
    ),
    "detect_known_derived": f"""
select doc_id::bigint as doc_id, rule, (strpos(text, value) - 1)::bigint as "start",
  (strpos(text, value) - 1 + length(value))::bigint as "end", value
from ({fx.plain(fx.LETTERS)}) join (
  select c_custkey as at_customer, null as at_supplier, 'name_known' as rule, 'PARTNER' || c_custkey || ' Varga' as value from customer where c_custkey % 3 > 0
  union all select null, s_suppkey, 'company_known', 'House' || s_suppkey || ' of oak' from supplier)
  on customer = at_customer or supplier = at_supplier""",
    "detect_distinct_blocks": _spans(resolved_ctes(_ALL_LINES), "spans"),
    "luhn_valid": _raw_hits((LONG_NUMBER, 0), f"{ck.luhn('f')} as is_valid"),
    "ssn_valid": _raw_hits(("[0-9]{3}-[0-9]{2}-[0-9]{4}", 0), f"{ck.ssn_ok('f')} as is_valid"),
    "ipv4_valid": _raw_hits((r"[0-9]{1,4}(?:\.[0-9]{1,4})+", 0), f"{ck.ipv4_ok('f')} as is_valid"),
    "phone_digit_filter": _raw_hits(
        "phone_context",
        f"length({ck.digits('f')})::bigint as n_digits, "
        f"length({ck.digits('f')}) between {fv.PHONE_CONTEXT_DIGITS[0]} and {fv.PHONE_CONTEXT_DIGITS[1]} as labelled, "
        f"length({ck.digits('f')}) between {fv.PHONE_STANDALONE_DIGITS[0]} and {fv.PHONE_STANDALONE_DIGITS[1]} as standalone",
    ),
    "guard_currency": _raw_hits(
        "phone_standalone",
        f"{ck.window_before('s', fv.CURRENCY_WINDOW)} as before, "
        f"{ck.currency(ck.window_before('s', fv.CURRENCY_WINDOW))} as is_amount",
    ),
    "guard_version": _raw_hits(
        "ipv4",
        f"{ck.window_before('s', fv.VERSION_WINDOW)} as before, "
        f"{ck.version(ck.window_before('s', fv.VERSION_WINDOW))} as is_version",
    ),
    "trim_spans": _without_terms(),
    "stop_company": _company_hits("", f"value not in ({', '.join(q(s) for s in fv.COMPANY_STOPS)})"),
    "company_prefix_rules": _company_hits(
        ", (value like 'Companies Act%' or value like 'Section %') as is_statute"
        f", (value like 'The %' and len({ck.words('value')}) = 2) as is_bare, {ck.company_ok('value')} as allowed"
    ),
    "name_guards": _raw_hits(
        "name_role", f"{ck.not_stop_name('f')} as not_stop, {ck.name_ok('f')} as allowed"
    ),
    "normalize_keys": recursive(entity_ctes(), "select distinct pii_type, value, key from entities"),
    "normalize_match_text": f"""
select passage_id::bigint as passage_id, truth_idx::bigint as truth_idx, value, {ck.match_text('value')} as normalised
from ({fx.plain(fx.TRUTH)})""",
    "mapping_audit": recursive(
        entity_ctes(),
        "select distinct pii_type, key as normalized_original, replacement as synthetic_replacement from entities",
    ),
    "mapping_total": recursive(
        entity_ctes(),
        f"select {q(fv.MAPPING_NOTICE)} as notice, count(*) as total_mappings "
        "from (select distinct pii_type, key from entities)",
    ),
    "mapping_consistency": recursive(
        entity_ctes(),
        "select pii_type, count(*) as n_keys, max(n) as most_replacements from "
        "(select pii_type, key, count(distinct replacement) as n from entities group by all) group by pii_type",
    ),
    "redact_documents": recursive(
        f"{entity_ctes(ck.tables_sql(['documents']), known=False)}, {ck.REDACTED}",
        "select doc_id, text, n_redactions from redacted",
    ),
    "redact_corpus": recursive(
        f"{entity_ctes()}, {ck.REDACTED}", f"select {KEYS}, text, n_redactions from redacted"
    ),
    "redaction_counts": recursive(
        resolved_ctes(),
        f"select c.pii_type, count(s.pii_type) as n from {ck.CATEGORIES} c "
        "left join spans s on s.pii_type = c.pii_type group by c.pii_type",
    ),
    "run_summary": recursive(
        entity_ctes(),
        "select count(*) as total_redactions, count(distinct (pii_type, key)) as unique_entities, "
        + ", ".join(f"count(*) filter (pii_type = '{c}') as n_{c.lower()}" for c in fv.CATEGORIES)
        + " from entities",
    ),
    "block_redaction_count": recursive(
        resolved_ctes(_DOC_LINES, known=False),
        "select doc_id, block_id, coalesce(n, 0)::bigint as n_redactions from corpus "
        "left join (select doc_id, block_id, count(*) as n from spans group by all) using (doc_id, block_id)",
    ),
    "residual_leaks": recursive(
        f"{entity_ctes()}, {ck.REDACTED}",
        f"select distinct {KEYS}, pii_type, value from entities join redacted using ({KEYS}) "
        "where contains(text, value)",
    ),
    "mapping_assigned": recursive(
        f"{entity_ctes()}, {ck.assigned_ctes()}",
        "select pii_type, key as normalized_original, replacement as synthetic_replacement from given",
    ),
    "redact_corpus_assigned": recursive(
        f"{entity_ctes().replace('entities as materialized', 'hashed_entities as materialized')}, "
        f"{ck.assigned_ctes().replace('from entities', 'from hashed_entities')}, "
        "entities as materialized (select h.* exclude (replacement), coalesce(g.replacement, h.replacement) as replacement "
        f"from hashed_entities h left join given g on g.pii_type = h.pii_type and g.key = h.key), {ck.REDACTED}",
        f"select {KEYS}, text, n_redactions from redacted",
    ),
    "residual_leaks_document": recursive(
        f"{entity_ctes()}, {ck.REDACTED}",
        f"select {', '.join('r.' + k for k in KEYS.split(', '))}, pii_type, value, {ck.residual_reason('r.text', 'value')} as reason "
        "from (select distinct source, doc_id, pii_type, value from entities) o "
        "join redacted r on r.source = o.source and r.doc_id = o.doc_id and contains(r.text, value)",
    ),
    "residual_leaks_corpus": recursive(
        f"{entity_ctes()}, {ck.REDACTED}",
        "select pii_type, value, count(*) as n_blocks from (select distinct pii_type, value from entities) "
        "join redacted on contains(text, value) group by all",
    ),
}

CHECKS.update({
    f"detect_{rule}": ck.with_corpus(f"select {SPAN_COLUMNS} from ({ck.rule_sql(rule)})")
    for rule, _ in fv.RULES
})
for short, kind in SURROGATES.items():
    rules = [r for r, t in fv.RULES if t == kind]
    CHECKS[f"surrogate_{short}"] = recursive(
        entity_ctes(rules=rules),
        "select distinct key as normalized_original, replacement as synthetic_replacement from entities",
    )


# --- styled runs ---------------------------------------------------------------------------


def _run_ctes(sql: str) -> str:
    texts = (
        "select 'runs' as source, doc_id::bigint as doc_id, 0::bigint as block_id, "
        f"string_agg(text, '' order by run_id) as text from ({fx.plain(sql)}) group by doc_id"
    )
    return f"""{entity_ctes(texts, known=False)},
placed as materialized (select doc_id::bigint as doc_id, run_id::bigint as run_id, text, bold, italic,
    coalesce(sum(length(text)) over (partition by doc_id order by run_id rows between unbounded preceding and 1 preceding), 0)::bigint as rs,
    sum(length(text)) over (partition by doc_id order by run_id)::bigint as re from ({fx.plain(sql)})),
touched as materialized (select r.doc_id, run_id, pii_type, "start" as xs, "end" as xe, replacement, rs, re, r.text,
    lag("end") over (partition by r.doc_id, run_id order by "start") as done
  from placed r join entities x on x.doc_id = r.doc_id and greatest("start", rs) < least("end", re)),
rewritten as (select doc_id, run_id,
    string_agg(substr(text, coalesce(done, rs) - rs + 1, greatest(xs - coalesce(done, rs), 0))
      || case when xs >= rs then replacement else '' end, '' order by xs)
    || substr(any_value(text), least(max(xe), any_value(re)) - any_value(rs) + 1) as new_text
  from touched group by doc_id, run_id),
out_runs as (select doc_id, run_id, coalesce(new_text, text) as text, bold, italic
  from placed left join rewritten using (doc_id, run_id))"""


_LAYOUT = (
    "count(distinct doc_id) as n_blocks, count(*) as n_runs, "
    "count(*) filter (bold) as n_bold, count(*) filter (italic) as n_italic"
)
CHECKS.update({
    "redact_runs_single": recursive(_run_ctes(fx.SINGLE_RUNS), "select * from out_runs"),
    "redact_runs_multi": recursive(_run_ctes(fx.RUNS), "select * from out_runs"),
    "span_run_overlap": recursive(
        _run_ctes(fx.RUNS), 'select doc_id, pii_type, xs as "start", xe as "end", run_id from touched'
    ),
    "run_offsets": recursive(
        _run_ctes(fx.RUNS), 'select doc_id, run_id, rs as "start", re as "end" from placed'
    ),
    "layout_preserved": recursive(
        _run_ctes(fx.RUNS),
        f"select 'before' as state, {_LAYOUT} from placed union all select 'after', {_LAYOUT} from out_runs",
    ),
})

# --- evaluation ------------------------------------------------------------------------------

_CASE_TEXTS = (
    "select 'cases' as source, case_id::bigint as doc_id, 0::bigint as block_id, text "
    f"from ({fx.plain(fx.CASES)}) union all "
    f"select 'negatives', case_id::bigint, 0, text from ({fx.plain(fx.NEGATIVES)})"
)
_CASE_CTES = f"""{resolved_ctes(_CASE_TEXTS, known=False)},
cases as materialized (select case_id::bigint as case_id, pii_type, expected from ({fx.plain(fx.CASES)})),
pairs as materialized (select case_id, c.pii_type, s.value,
    (contains(expected, s.value) or contains(s.value, expected)) as hit
  from cases c left join spans s on s.source = 'cases' and s.doc_id = c.case_id and s.pii_type = c.pii_type),
case_scores as materialized (select case_id, pii_type,
    (coalesce(bool_or(hit), false))::bigint as tp, count(*) filter (value is not null and not hit) as fp,
    1 - (coalesce(bool_or(hit), false))::bigint as fn from pairs group by case_id, pii_type),
clean as (select count(*) as n from corpus c where source = 'negatives'
  and not exists (select 1 from spans s where s.source = 'negatives' and s.doc_id = c.doc_id))"""

_TRUTH = f"select passage_id::bigint as passage_id, truth_idx::bigint as truth_idx, pii_type, value from ({fx.plain(fx.TRUTH)})"
_PASSAGE_TEXTS = (
    f"select 'p' as source, doc_id::bigint as doc_id, 0::bigint as block_id, text from ({fx.plain(fx.CONTACTS)})"
)
_PASSAGE_CTES = f"""truth as materialized ({_TRUTH}),
predictions as materialized (select doc_id as passage_id,
    row_number() over (partition by doc_id order by "start") - 1 as prediction, pii_type, "start", value,
    {ck.match_text('value')} as form from spans where source = 'p'),
labels as materialized (select *, {ck.match_text('value')} as form from truth),
matches as materialized (select r.passage_id, prediction, r.pii_type, "start", r.value, truth_idx, l.value as label,
    {ck.values_match('r.form', 'l.form')} as is_match
  from predictions r join labels l on l.passage_id = r.passage_id and l.pii_type = r.pii_type),
options as materialized (select passage_id, prediction, pii_type, value,
    coalesce((select list(truth_idx order by truth_idx) from matches m where m.passage_id = r.passage_id
      and m.prediction = r.prediction and is_match), []) as idxs from predictions r),
taking as (
  select passage_id, prediction, pii_type, value, coalesce(idxs[1], -1) as truth_idx, [coalesce(idxs[1], -1)] as taken
  from options where prediction = 0
  union all
  select o.passage_id, o.prediction, o.pii_type, o.value,
    coalesce(list_filter(o.idxs, lambda x: not list_contains(t.taken, x))[1], -1),
    list_append(t.taken, coalesce(list_filter(o.idxs, lambda x: not list_contains(t.taken, x))[1], -1))
  from taking t join options o on o.passage_id = t.passage_id and o.prediction = t.prediction + 1),
outcomes as materialized (
  select pii_type, case when truth_idx >= 0 then 'tp' else 'fp' end as outcome from taking
  union all
  select pii_type, 'fn' from truth l where not exists (select 1 from taking t
    where t.passage_id = l.passage_id and t.truth_idx = l.truth_idx))"""


def _metrics(counts: str, observed: str) -> str:
    """Unrounded per-type metrics from (pii_type, tp, fp, fn)."""
    return f"""select pii_type, tp, fp, fn, observed, precision, recall,
  case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1
from (select *, case when tp + fp > 0 then tp::double / (tp + fp) when fn = 0 then 1.0 else 0.0 end as precision,
    case when tp + fn > 0 then tp::double / (tp + fn) else 1.0 end as recall
  from (select c.pii_type, coalesce(tp, 0)::bigint as tp, coalesce(fp, 0)::bigint as fp,
      coalesce(fn, 0)::bigint as fn, {observed} as observed
    from {ck.CATEGORIES} c left join ({counts}) s on s.pii_type = c.pii_type))"""


_OUTCOME_COUNTS = (
    "select pii_type, count(*) filter (outcome = 'tp') as tp, count(*) filter (outcome = 'fp') as fp, "
    "count(*) filter (outcome = 'fn') as fn from outcomes group by pii_type"
)
_CASE_COUNTS = (
    "select pii_type, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (select pii_type, tp, fp, fn from case_scores "
    "union all select pii_type, 0, 1, 0 from spans where source = 'negatives') group by pii_type"
)
_PASSAGE_METRICS = _metrics(_OUTCOME_COUNTS, "c.pii_type in (select pii_type from truth)")
_CASE_METRICS = _metrics(_CASE_COUNTS, "true")
_ROUNDED = (
    "pii_type, tp, fp, fn, observed, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1"
)


def _averages(metrics: str) -> str:
    return f"""
select tp, fp, fn, round(p, 4) as micro_precision, round(r, 4) as micro_recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as micro_f1,
  round(mp, 4) as macro_precision, round(mr, 4) as macro_recall, round(mf, 4) as macro_f1
from (select tp, fp, fn, mp, mr, mf, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as p,
    case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as r
  from (select coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(fp), 0)::bigint as fp,
      coalesce(sum(fn), 0)::bigint as fn,
      coalesce(avg(precision), 0.0) as mp, coalesce(avg(recall), 0.0) as mr, coalesce(avg(f1), 0.0) as mf
    from ({metrics}) where observed or tp + fn > 0))"""


def _scoped(tier: str, metrics: str) -> str:
    averages = " union all ".join(
        f"select '{tier}', '{kind}', null, tp, fp, fn, true, {kind}_precision, {kind}_recall, {kind}_f1 "
        f"from ({_averages(metrics)})"
        for kind in ("micro", "macro")
    )
    return f"select '{tier}' as tier, 'type' as scope, {_ROUNDED} from ({metrics}) union all {averages}"


_PASSAGES = f"{resolved_ctes(_PASSAGE_TEXTS, known=False)}, {_PASSAGE_CTES}"
_BOTH = (
    f"{resolved_ctes(_CASE_TEXTS + ' union all ' + _PASSAGE_TEXTS, known=False)}, "
    f"{_CASE_CTES.split('spans as materialized', 1)[1].split('),', 1)[1]}"
)

CHECKS.update({
    "truth_rows": _TRUTH,
    "eval_cases": recursive(_CASE_CTES, "select case_id, pii_type, tp, fp, fn from case_scores"),
    "eval_negatives": recursive(
        _CASE_CTES,
        "select 'TRUE_NEGATIVE' as pii_type, n from clean union all "
        "select pii_type, count(*) from spans where source = 'negatives' group by pii_type",
    ),
    "match_values": recursive(
        _PASSAGES, 'select passage_id, pii_type, "start", value, truth_idx, label, is_match from matches'
    ).replace("select passage_id, pii_type,", "select passage_id,"),
    "eval_passages": recursive(_PASSAGES, "select passage_id, prediction, pii_type, value, truth_idx from taking"),
    "metrics_per_type": recursive(_PASSAGES, f"select {_ROUNDED} from ({_PASSAGE_METRICS})"),
    "metrics_micro_macro": recursive(_PASSAGES, _averages(_PASSAGE_METRICS)),
    "binary_accuracy": recursive(
        _CASE_CTES,
        "select round(((select sum(tp) from case_scores) + (select n from clean))::double / "
        "(select count(*) from corpus), 4) as accuracy",
    ),
    "eval_report": recursive(
        _PASSAGES,
        "select pii_type, observed, "
        + ", ".join(f"case when observed then {c} end as {c}" for c in ("tp", "fp", "fn", "precision", "recall", "f1"))
        + f" from (select {_ROUNDED} from ({_PASSAGE_METRICS}))",
    ),
    "evaluation_run": recursive(
        f"{_BOTH}, {_PASSAGE_CTES}",
        f"{_scoped('cases', _CASE_METRICS)} union all {_scoped('passages', _PASSAGE_METRICS)}",
    ),
    "evaluation_full": recursive(
        f"{_BOTH}, {_PASSAGE_CTES}, every as materialized ("
        "select 'cases' as tier, pii_type, tp, fp, fn, 1 as texts, tp as good from case_scores "
        "union all select 'cases', pii_type, 0, 1, 0, 0, 0 from spans where source = 'negatives' "
        "union all select 'cases', null, 0, 0, 0, 1, (not exists (select 1 from spans s where s.source = 'negatives' "
        "and s.doc_id = c.doc_id))::int from corpus c where source = 'negatives' "
        "union all select 'passages', pii_type, (outcome = 'tp')::int, (outcome = 'fp')::int, (outcome = 'fn')::int, 0, 0 from outcomes "
        "union all select 'passages', null, 0, 0, 0, 1, 0 from corpus where source = 'p')",
        "select scope, tier, pii_type, tp, fp, fn, tp + fp + fn as n, round(p, 4) as precision, round(r, 4) as recall, "
        "round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1, "
        "case when scope <> 'type' then texts end as n_texts, "
        f"case when scope = 'tier' and tier = 'cases' then round(good / texts, 4) end as accuracy, '{ck.su.DEFAULT_AS_OF}' as as_of "
        "from (select *, case when tp + fp > 0 then tp / (tp + fp) when fn = 0 then 1.0 else 0.0 end as p, "
        "case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as r from ("
        "select case when grouping(tier) = 1 then 'all' when grouping(pii_type) = 1 then 'tier' else 'type' end as scope, tier, pii_type, "
        "sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(texts)::bigint as texts, sum(good)::bigint as good "
        "from every group by grouping sets ((tier, pii_type), (tier), ()))) where scope <> 'type' or pii_type is not null",
    ),
    "labels_json": f"""select case when passage_id % 3 > 0 then 'shelf ' || passage_id else 'unknown' end as source,
  case when passage_id % 4 > 0 then 'text ' || passage_id else '' end as text, pii_type, value from ({_TRUTH}) where passage_id % 7 <> 3""",
    "labels_damaged": "select left('{' || chr(34) || 'id' || chr(34) || ':' || chr(34) || c_custkey || chr(34) || ',' || chr(34) || 'metadata', 12) "
    "as raw from customer where c_custkey % 7 = 3",
    "stream_dedup": "select event_id::bigint as doc_id, 'host 10.' || (event_id % 300) || '.0.' || (user_id % 256) || ' mail u' || user_id "
    "|| '@mail.example.org' as text from events",
    "stream_mapping": recursive(
        entity_ctes(
            "select 'events' as source, event_id::bigint as doc_id, 0::bigint as block_id, "
            "'host 10.' || (event_id % 300) || '.0.' || (user_id % 256) || ' mail u' || user_id || '@mail.example.org' as text from events",
            known=False,
        ),
        "select distinct pii_type, key as normalized_original, replacement as synthetic_replacement from entities",
    ),
    "stream_redact": CHECKS["redact_documents"],
    "stream_counts": recursive(
        resolved_ctes(
            "select 'events' as source, event_id::bigint as doc_id, 0::bigint as block_id, "
            "'host 10.' || (event_id % 300) || '.0.' || (user_id % 256) || ' mail u' || user_id || '@mail.example.org' "
            "as text from events",
            rules=["email", "ipv4"],
        ),
        "select time_bucket(interval '1 hour', ts) as window_start, pii_type, count(*) as n "
        "from spans join events on event_id = doc_id "
        "where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes' "
        "group by all",
    ),
})
