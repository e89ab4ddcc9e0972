"""Check SQL: every query again, as plain SQL over the parquet tables (DuckDB dialect).

The SQL recomputes results from the raw tables with an RE2 regex engine, window
functions and recursive queries; it never reads what the Spark side wrote.
"""

from __future__ import annotations

from ..functions import fixed_values as fv, patterns as p, surrogates as su
from ..operators import assigned as asg
from ..sources import fixtures as fx
from ..sources.readers import TEXT_TABLES

ORDER = {rule: i for i, (rule, _) in enumerate(fv.RULES)}
TYPE = dict(fv.RULES)
KEYS = "source, doc_id, block_id"


def q(text: str) -> str:
    """A SQL string literal; line breaks and tabs are spelled with chr()."""
    body = text.replace("'", "''")
    for char in "\n\r\t":
        body = body.replace(char, f"' || chr({ord(char)}) || '")
    return f"('{body}')" if "||" in body else f"'{body}'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


BLANKS = "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8239)||chr(8201))"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def rstrip_marks(x: str) -> str:
    return f"rtrim({x}, {q(fv.TRAILING_PUNCTUATION)})"


def digits(x: str) -> str:
    return rf"regexp_replace({x}, '\P{{Nd}}', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, {q(p.re2(chr(92) + 's+'))}), lambda w: w <> '')"


def luhn(x: str) -> str:
    d = digits(x)
    return (
        f"(length({d}) between {fv.CARD_DIGITS[0]} and {fv.CARD_DIGITS[1]} and "
        f"list_sum([case when i % 2 = 1 and 2 * substr(reverse({d}), i + 1, 1)::int > 9 "
        f"then 2 * substr(reverse({d}), i + 1, 1)::int - 9 "
        f"when i % 2 = 1 then 2 * substr(reverse({d}), i + 1, 1)::int "
        f"else substr(reverse({d}), i + 1, 1)::int end for i in range(length({d}))]) % 10 = 0)"
    )


def ssn_ok(x: str) -> str:
    d = digits(x)
    return (
        f"(length({d}) = 9 and substr({d}, 1, 3)::int not in (0, 666) and substr({d}, 1, 3)::int < 900 "
        f"and substr({d}, 4, 2)::int <> 0 and substr({d}, 6, 4)::int <> 0)"
    )


def ipv4_ok(x: str) -> str:
    octets = f"string_split({x}, '.')"
    return (
        f"(len({octets}) = 4 and len(list_filter({octets}, lambda o: "
        f"regexp_full_match(o, '[0-9]+') and try_cast(o as int) <= 255 "
        f"and (length(o) = 1 or not starts_with(o, '0')))) = 4)"
    )


def window_before(start: str, width: int) -> str:
    return f"substr(text, greatest({start} - {width}, 0) + 1, least({start}, {width}))"


def version(w: str) -> str:
    return f"contains(lower({w}), 'v')"


def currency(w: str) -> str:
    return "(" + " or ".join(f"contains({w}, {q(t)})" for t in fv.CURRENCY_TOKENS) + ")"


def company_ok(x: str) -> str:
    bad = " or ".join(f"starts_with({x}, {q(b)})" for b in fv.COMPANY_BAD_PREFIXES)
    return (
        f"({x} not in ({', '.join(q(s) for s in fv.COMPANY_STOPS)}) and not ({bad}) "
        f"and not (starts_with({x}, 'The ') and len({words(x)}) = 2))"
    )


def not_stop_name(x: str) -> str:
    return (
        f"({x} not in ({', '.join(q(s) for s in fv.NAME_STOPS)}) and lower({words(x)}[1]) not in "
        f"({', '.join(q(s) for s in fv.NON_NAME_FIRST_WORDS)}))"
    )


def name_ok(x: str) -> str:
    legal = " or ".join(f"contains({x}, {q(t)})" for t in fv.NAME_LEGAL_TOKENS)
    return f"({not_stop_name(x)} and not ({legal}))"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        f"lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def key(kind: str, x: str) -> str:
    d = digits(strip(x))
    collapsed = strip(f"regexp_replace({x}, {q(p.re2(chr(92) + 's+'))}, ' ', 'g')")
    return (
        f"case when {kind} = 'EMAIL' then lower({strip(x)}) "
        f"when {kind} = 'PHONE' then case when length({d}) >= {fv.PHONE_KEY_MIN_DIGITS} then {d} else {strip(x)} end "
        f"when {kind} in ('FULL_NAME', 'COMPANY') then {title(collapsed)} else {strip(x)} end"
    )


# --- texts -------------------------------------------------------------------------------


def tables_sql(names=tuple(TEXT_TABLES)) -> str:
    parts = []
    for name in names:
        doc, block, text = TEXT_TABLES[name]
        parts.append(
            f"select '{name}' as source, {doc}::bigint as doc_id, {block or 0}::bigint as block_id, "
            f"{text} as text from {name}"
        )
    return " union all ".join(parts)


def corpus_sql() -> str:
    parts = [tables_sql()]
    for name, (sql, _) in fx.TEXTS.items():
        parts.append(
            f"select '{name}' as source, doc_id::bigint as doc_id, 0::bigint as block_id, text "
            f"from ({fx.plain(sql)})"
        )
    return " union all ".join(parts)


# --- rules ---------------------------------------------------------------------------------


def _hits(pattern: str, group: int, corpus: str = "corpus", where: str = "true") -> str:
    """(keys, text, f, s, e): reported text and offsets of every match."""
    lit = q(pattern)
    value = "m1[i]" if group else "m0[i]"
    back = "length(m0[i]) - length(m1[i])" if group else "0"
    return f"""select {KEYS}, text, {value} as f, s0 + {back} as s, s0 + {back} + length({value}) as e
from (select *, coalesce(list_sum([length(x) for x in gaps[1:i]]), 0)::bigint
         + coalesce(list_sum([length(x) for x in m0[1:i - 1]]), 0)::bigint as s0
  from (select *, unnest(range(1, len(m0) + 1)) as i from (
    select {KEYS}, text, regexp_extract_all(text, {lit}, 0) as m0,
      regexp_extract_all(text, {lit}, {group}) as m1, string_split_regex(text, {lit}) as gaps
    from {corpus} where {where} and regexp_matches(text, {lit}))))"""


def _span(rule: str, hits: str, value: str = "f", start: str = "s", where: str = "true") -> str:
    return f"""select {KEYS}, '{TYPE[rule]}' as pii_type, '{rule}' as rule, {ORDER[rule]} as ord,
  ({start})::bigint as "start", (({start}) + length({value}))::bigint as "end", {value} as value
from ({hits}) where {where}"""


def _address_pattern() -> str:
    level = f"select *, {strip('f')} as c0, length(f) - length(ltrim(f, {BLANKS})) as lead from ({_hits(*p.RE2['address_pattern'])})"
    for i, term in enumerate(fv.CONTACT_TERMS):
        cut = strip(f"left(c{i}, length(c{i}) - {len(term)})")
        level = (
            f"select *, case when ends_with(c{i}, {q(term)}) then {cut} else c{i} end as c{i + 1} from ({level})"
        )
    last = f"c{len(fv.CONTACT_TERMS)}"
    cleaned = f"""select *,
  case when {last} <> c0 then {rstrip_marks(last)} when {rstrip_marks('f')} <> f then {rstrip_marks('f')} else c0 end as v,
  case when {last} <> c0 then s + lead when {rstrip_marks('f')} <> f then s else s + lead end as vs
from ({level})"""
    return _span("address_pattern", cleaned, "v", "vs", f"length(v) >= {fv.ADDRESS_PATTERN_MIN_LENGTH}")


def _stripped_span(rule: str, where: str) -> str:
    inner = (
        f"select *, {strip('f')} as v, s + length(f) - length(ltrim(f, {BLANKS})) as vs "
        f"from ({_hits(*p.RE2[rule])})"
    )
    return _span(rule, inner, "v", "vs", where)


def _promoters() -> str:
    names = f"""select distinct {KEYS}, text, n from (
  select {KEYS}, text, {strip("unnest(regexp_split_to_array(f, ',|" + chr(92) + "band" + chr(92) + "b'))")} as n
  from ({_hits(*p.RE2['name_promoters'])}))
where len({words('n')}) between {fv.PROMOTER_WORDS[0]} and {fv.PROMOTER_WORDS[1]} and {not_stop_name('n')}"""
    places = f"""select {KEYS}, n as f,
  coalesce(list_sum([length(x) for x in gaps[1:i]]), 0)::bigint + (i - 1) * length(n) as s
from (select *, unnest(range(1, len(gaps))) as i from (
  select {KEYS}, n, string_split(text, n) as gaps from ({names})))"""
    return _span("name_promoters", places)


def _known(rule: str, entries) -> str:
    parts = []
    for entry in sorted(entries):
        hits = _hits(rf"(?i)\b{p.escape(entry)}\b", 0)
        parts.append(_span(rule, hits))
    return " union all ".join(parts)


def rule_sql(rule: str) -> str:
    """Spans of one rule over ``corpus``."""
    if rule == "address_pattern":
        return _address_pattern()
    if rule == "name_promoters":
        return _promoters()
    if rule == "name_known":
        return _known(rule, fx.KNOWN_NAMES)
    if rule == "company_known":
        return _known(rule, fx.KNOWN_COMPANIES)
    if rule == "phone_standalone":
        lo, hi = fv.PHONE_STANDALONE_DIGITS
        return _stripped_span(
            rule,
            f"length({digits('v')}) between {lo} and {hi} "
            f"and not {currency(window_before('s', fv.CURRENCY_WINDOW))}",
        )
    if rule == "company_suffix":
        return _stripped_span(rule, company_ok("v"))
    hits = _hits(*p.RE2[rule])
    where, value = "true", "f"
    if rule == "ssn":
        where = ssn_ok("f")
    elif rule == "card":
        where = luhn("f")
    elif rule == "ipv4":
        where = f"not {version(window_before('s', fv.VERSION_WINDOW))} and {ipv4_ok('f')}"
    elif rule == "phone_context":
        lo, hi = fv.PHONE_CONTEXT_DIGITS
        where, value = f"length({digits('f')}) between {lo} and {hi}", rstrip_marks("f")
    elif rule == "address_context":
        value = rstrip_marks("f")
        where = f"length({value}) >= {fv.ADDRESS_CONTEXT_MIN_LENGTH}"
    elif rule.startswith("name_"):
        where = name_ok("f")
    return _span(rule, hits, value, "s", where)


SPAN_COLUMNS = f'{KEYS}, pii_type, rule, "start", "end", value'


def with_corpus(body: str, corpus: str | None = None) -> str:
    return f"with corpus as materialized ({corpus or corpus_sql()}) {body}"


def candidate_ctes(corpus: str | None = None, rules=None, known: bool = True) -> str:
    chosen = [
        r for r, _ in fv.RULES
        if (rules is None or r in rules) and (known or not r.endswith("_known"))
    ]
    union = " union all ".join(f"({rule_sql(r)})" for r in chosen)
    return f"corpus as materialized ({corpus or corpus_sql()}), candidates as materialized ({union})"


def resolved_ctes(corpus: str | None = None, rules=None, known: bool = True) -> str:
    return f"""{candidate_ctes(corpus, rules, known)},
numbered as materialized (select *, row_number() over (partition by {KEYS}
    order by "start", "end" desc, ord, value) as rn from candidates),
sweep as (
  select *, true as kept, "end" as reach from numbered where rn = 1
  union all
  select n.*, n."start" >= s.reach, case when n."start" >= s.reach then n."end" else s.reach end
  from sweep s join numbered n on n.source = s.source and n.doc_id = s.doc_id
    and n.block_id = s.block_id and n.rn = s.rn + 1),
spans as materialized (select * exclude (rn, kept, reach) from sweep where kept)"""


def _surrogate(kind: str, k: str, h: str, as_of: str = su.DEFAULT_AS_OF) -> str:
    def num(i: int) -> str:
        return f"('0x' || substr({h}, {1 + 8 * i}, 8))::bigint"

    def choose(options, n: str) -> str:
        return f"{sql_list(options)}[({n}) % {len(options)} + 1]"

    first, next_first = choose(su.FIRST_NAMES, num(0)), choose(su.FIRST_NAMES, num(0) + " + 1")
    last = choose(su.LAST_NAMES, num(1))
    mail = f"lower({first} || '.' || {last}) || '@{fv.EMAIL_DOMAIN}'"
    next_mail = f"lower({next_first} || '.' || {last}) || '@{fv.EMAIL_DOMAIN}'"
    suffix = " ".join(f"when contains(lower({k}), {q(s.lower())}) then {q(s)}" for s in fv.COMPANY_FORMS)
    first_day = int(fv.DOB_AGE_YEARS[0] * 365.25) + 1
    days = int((fv.DOB_AGE_YEARS[1] + 1) * 365.25) - first_day + 1
    born = f"(date '{as_of}' - (({num(0)}) % {days} + {first_day})::int)"
    area = f"(({num(0)}) % 898 + 1)"
    cities = {i: choose([c[i] for c in su.CITIES], num(2)) for i in range(3)}
    return f"""case
when {kind} = 'FULL_NAME' then case when lower({first} || ' ' || {last}) = lower({k}) then {next_first} || ' ' || {last} else {first} || ' ' || {last} end
when {kind} = 'EMAIL' then case when {mail} = lower({k}) then {next_mail} else {mail} end
when {kind} = 'PHONE' then case
  when length({k}) = 12 and starts_with({k}, '91') then '+91 ' || (60000 + {num(0)} % 40000) || ' ' || (10000 + {num(1)} % 90000)
  when contains({k}, '20') then '+91 20 ' || (2000 + {num(0)} % 8000) || ' ' || (1000 + {num(1)} % 9000)
  else '+91 ' || (7000000000 + {num(0)} % 3000000000) end
when {kind} = 'COMPANY' then {choose(su.COMPANY_WORDS, num(0))} || ' Enterprises ' || case {suffix} else '{fv.COMPANY_DEFAULT_FORM}' end
when {kind} = 'ADDRESS' then ({num(0)} % 999 + 1) || ' ' || {choose(su.STREETS, num(1))} || ', ' || {cities[0]} || ', ' || {cities[1]} || ' – ' || {cities[2]} || lpad(({num(3)} % 1000)::varchar, 3, '0') || ', India'
when {kind} = 'SSN' then lpad(({area} + case when {area} >= 666 then 1 else 0 end)::varchar, 3, '0') || '-' || lpad(({num(1)} % 99 + 1)::varchar, 2, '0') || '-' || lpad(({num(2)} % 9999 + 1)::varchar, 4, '0')
when {kind} = 'CREDIT_CARD' then case when {digits(k)} = {digits(choose(fv.TEST_CARDS, num(0)))} then {choose(fv.TEST_CARDS, num(0) + ' + 1')} else {choose(fv.TEST_CARDS, num(0))} end
when {kind} = 'DOB' then case when contains({k}, '/') then strftime({born}, '%d/%m/%Y') when contains({k}, '-') then strftime({born}, '%d-%m-%Y') else strftime({born}, '%d %B %Y') end
when {kind} = 'IP_ADDRESS' then case {num(0)} % 3 when 0 then '10.' || ({num(1)} % 256) when 1 then '172.' || ({num(1)} % 16 + 16) else '192.168' end || '.' || ({num(2)} % 256) || '.' || ({num(3)} % 256)
else '{fv.FALLBACK_REPLACEMENT}' end"""


def entity_ctes(corpus: str | None = None, rules=None, known: bool = True) -> str:
    return f"""{resolved_ctes(corpus, rules, known)},
keyed as materialized (select *, {key('pii_type', 'value')} as key from spans),
hashed as materialized (select *, sha256('{fx.SALT}|' || pii_type || '|' || key) as h from keyed),
entities as materialized (select * exclude (h), {_surrogate('pii_type', 'key', 'h')} as replacement from hashed)"""


def _mixed(space: str, place: str, k: str) -> str:
    """The value at a place (l, r) of a value space; see ``assigned``."""
    def choose(options, n: str) -> str:
        return f"{sql_list(options)}[({n}) % {len(options)} + 1]"

    def letter(n: str) -> str:
        return f"substr('{asg.LETTERS}', (({n}) % 26 + 1)::int, 1)"

    names, last, n = len(su.FIRST_NAMES), len(su.LAST_NAMES), len(su.COMPANY_WORDS)
    forms = " ".join(f"when contains(lower({k}), {q(f.lower())}) then {q(f)}" for f in fv.COMPANY_FORMS)
    words = " || ' ' || ".join(choose(su.COMPANY_WORDS, f"{d} // {n**i}") for d in "lr" for i in range(3))
    city, state, pin = (choose([c[i] for c in su.CITIES], "r // 1000") for i in range(3))
    return {
        "FULL_NAME": f"{choose(su.FIRST_NAMES, 'l')} || ' ' || {letter(f'l // {names}')} || '. ' || {letter(f'l // {names * 26}')} || '. ' "
        f"|| {choose(su.LAST_NAMES, 'r')} || '-' || {choose(su.LAST_NAMES, f'r // {last}')}",
        "EMAIL": f"lower({choose(su.FIRST_NAMES, 'l')} || '.' || {choose(su.LAST_NAMES, f'l // {names}')} || '.' || lpad(r::varchar, 7, '0')) || '@{fv.EMAIL_DOMAIN}'",
        "PHONE_INDIA": "'+91 ' || (l + 60000) || ' ' || (r + 10000)",
        "PHONE_CITY": "'+91 20 ' || (l + 2000) || ' ' || (r + 1000)",
        "PHONE": "'+91 ' || (l + 70000) || lpad(r::varchar, 5, '0')",
        "COMPANY": f"{words} || ' Enterprises ' || case {forms} else '{fv.COMPANY_DEFAULT_FORM}' end",
        "ADDRESS": f"(l % 999 + 1) || ' ' || {choose(su.STREETS, 'l // 999')} || ', ' || {city} || ', ' || {state} || ' – ' || {pin} "
        "|| lpad((r % 1000)::varchar, 3, '0') || ', India'",
        "SSN": "lpad((l + 1 + case when l + 1 >= 666 then 1 else 0 end)::varchar, 3, '0') || '-' || "
        "lpad((r // 9999 + 1)::varchar, 2, '0') || '-' || lpad((r % 9999 + 1)::varchar, 4, '0')",
        "IP_ADDRESS": "case when l < 256 then '10.' || l when l < 272 then '172.' || (l - 240) else '192.168' end || '.' || (r // 256) || '.' || (r % 256)",
    }[space]


def assigned_ctes(salt: str = fx.SALT) -> str:
    """``given``: every distinct key of ``entities`` with a value of its own."""
    def number(*parts: str) -> str:
        return f"('0x' || substr(sha256('{salt}' || '|' || {" || '|' || ".join(parts)}), 1, 12))::bigint"

    spaces = (
        "case when pii_type = 'PHONE' then case when length(key) = 12 and starts_with(key, '91') then 'PHONE_INDIA' "
        "when contains(key, '20') then 'PHONE_CITY' else 'PHONE' end "
        f"when pii_type in ({', '.join(q(k) for k in asg.SPACES)}) then pii_type end"
    )
    level = (
        "select *, row_number() over (partition by space order by h, key) - 1 as number from "
        f"(select *, {number('space', 'key')} as h from (select *, {spaces} as space from "
        "(select distinct pii_type, key from entities)) where space is not null)"
    )
    radix = [f"case space {' '.join(f'when {q(k)} then {v[i]}' for k, v in asg.SPACES.items())} end" for i in range(2)]
    level = f"select *, number // b as l, number % b as r from (select *, {radix[0]} as a, {radix[1]} as b from ({level}))"
    for i in range(asg.ROUNDS):
        moved, other, size = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        step = number(f"'{i}'", "space", f"{other}::varchar")
        level = f"select * replace (({moved} + {step}) % {size} as {moved}) from ({level})"
    made = " ".join(f"when {q(k)} then {_mixed(k, 'l, r', 'key')}" for k in asg.SPACES)
    return f"given as materialized (select pii_type, key, case space {made} end as replacement from ({level}))"


REDACTED = f"""cut as (select *, lag("end", 1, 0) over (partition by {KEYS} order by "start") as done from entities),
spliced as (select {KEYS}, string_agg(substr(text, done + 1, "start" - done) || replacement, '' order by "start") as head,
    max("end") as reach, count(*) as n from cut join corpus using ({KEYS}) group by {KEYS}),
redacted as materialized (select {KEYS}, c.text as original,
    case when n is null then c.text else head || substr(c.text, reach + 1) end as text,
    coalesce(n, 0)::bigint as n_redactions from corpus c left join spliced using ({KEYS}))"""



def residual_reason(text: str, value: str) -> str:
    """Why the first place of a value in a redacted text was spared."""
    at = f"(strpos({text}, {value}) - 1)"
    before = window_before(at, fv.CURRENCY_WINDOW).replace("substr(text", f"substr({text}", 1)
    sides = f"substr({text}, {at}, least({at}, 1)) || substr({text}, {at} + length({value}) + 1, 1)"
    return (
        f"case when {currency(before)} then 'amount' when regexp_matches({sides}, '[\\p{{L}}\\p{{N}}_]') "
        "then 'within a word' else 'unrecognised' end"
    )


CATEGORIES = "(" + " union all ".join(
    f"select '{c}' as pii_type, {i} as ord" for i, c in enumerate(fv.CATEGORIES)
) + ")"


def recursive(ctes: str, body: str) -> str:
    return f"with recursive {ctes} {body}"


def match_text(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), {q(p.re2(fv.MATCH_SEPARATORS))}, ' ', 'g')")


def values_match(a: str, b: str) -> str:
    """On values already brought into match form."""
    ta, tb = (f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))" for x in (a, b))
    return (
        f"({a} <> '' and {b} <> '' and (contains({a}, {b}) or contains({b}, {a}) or "
        f"len(list_intersect({ta}, {tb})) >= {fv.MATCH_TOKEN_SHARE} * least(len({ta}), len({tb}))))"
    )
