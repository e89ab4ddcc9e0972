"""Text tables derived from the relational tables.

The text tables at hand hold no names, firms, addresses or birth dates.  These
queries build such texts from the keys of customers, suppliers, events and line
items, so they grow with those tables.  They use only SQL that Spark and other
engines share: ``{customer}`` and the like stand for the table.  Every person and
firm is invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fv
from ..session import dealt
from .readers import table

SALT = "maskwright"  # of the registered queries; data of your own needs one that nobody knows

KNOWN_NAMES = ("Asha Rao", "Jonas Brandt", "Meera Miller")
KNOWN_COMPANIES = ("Coral Bay Traders LLP", "Hazel & Finch", "Juniper N.A.", "Northlight")

_FIRST = ("Tom", "Asha", "Ravi", "Meera", "Jonas", "Leela", "Omar")
_LAST = (
    "Rao", "Iyer", "Miller", "Stone", "Varga", "Quint", "Osei", "Brandt", "Lind", "Moreau", "Takeda",
)
_WORD = ("Coral Bay", "Northlight", "Silver Oak", "Juniper", "Blue Mesa")
_CITY = ("Pune", "Mumbai", "Jaipur", "Surat")
_MONTH = ("January", "Mar", "August", "Sept", "December")


def pick(expr: str, options) -> str:
    whens = " ".join(f"when {i} then '{o}'" for i, o in enumerate(options))
    return f"case ({expr}) % {len(options)} {whens} end"


def pad(expr: str, width: int) -> str:
    return f"lpad(cast(({expr}) as string), {width}, '0')"


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _first(k: str) -> str:
    return pick(k, _FIRST)


def _last(k: str) -> str:
    return pick(k, _LAST)


def _by(expr: str, *texts: str) -> str:
    whens = " ".join(f"when {i} then {t}" for i, t in enumerate(texts))
    return f"case ({expr}) % {len(texts)} {whens} end"


_K, _S, _E = "c_custkey", "s_suppkey", "event_id"

IDS = f"""select {_K} as doc_id, {_text(
    "'Payroll SSN '", pad(_K + " * 7 % 1000", 3), "'-'", pad(_K + " % 100", 2), "'-'",
    pad(_K + " * 13 % 10000", 4), "'. '",
    _by(_K,
        _text("'DOB: '", pad(_K + " % 28 + 1", 2), "'/'", pad(_K + " % 12 + 1", 2), "'/'",
              f"cast(1950 + {_K} % 50 as string)"),
        _text("'Born: '", pad(_K + " % 28 + 1", 2), "'-'", pad(_K + " % 12 + 1", 2), "'-'",
              f"cast(1950 + {_K} % 50 as string)"),
        _text("'date of birth '", f"cast({_K} % 28 + 1 as string)", "'th '", pick(_K, _MONTH), "' '",
              f"cast(1950 + {_K} % 50 as string)"),
        _text("'D.O.B.: August '", f"cast({_K} % 28 + 1 as string)", "', '",
              f"cast(1950 + {_K} % 50 as string)"),
        _text("'Meeting on '", pad(_K + " % 28 + 1", 2), "'/04/2021'")),
    "'; card 4012 8888 8888 188'", f"cast({_K} % 10 as string)",
    "' or 5555-5555-5555-44'", pad(_K + " % 100", 2), "'.'")} as text from {{customer}}"""

CONTACTS = f"""select {_K} as doc_id, {_by(
    _K,
    _text("'Contact Person: '", _first(_K), "' '", _last(_K), "', Tel: +91 '",
          pad("70000 + " + _K + " % 10000", 5), "' '", pad("10000 + " + _K + " % 80000", 5),
          "' of '", pick(_K, _WORD), "' Traders LLP'"),
    _text("'Managing Director: '", _first(_K), "' '", _last(_K), "'; Mobile No. 98'",
          pad(_K + " % 100000000", 8), "'. '", pick(_K, _WORD), "' Metals Private Limited'"),
    _text("'The form was signed by Mr. '", _first(_K), "' '", _last(_K), "', for '", pick(_K, _WORD),
          "' Power Limited, Phone: (020) '", pad("2000 + " + _K + " % 8000", 4), "' '",
          pad(_K + " % 10000", 4), "';'"),
    _text("'Shri '", _first(_K), "' M '", _last(_K), "', appointed as Company Secretary at '",
          pick(_K, _WORD), "' Foods Pvt. Ltd. and Global Inc.'"),
    _text("'Compliance Officer '", _first(_K), "' '", _last(_K), "', namely '", _first(_K + " + 3"),
          "' '", _last(_K + " + 5"), "'. Fax: 022-'", pad(_K + " % 100000000", 8), "' Email: '",
          f"lower({_first(_K)})", "'.'", f"lower({_last(_K)})", "'@mail.example.org'"),
    _text("'Witness being '", _first(_K), "' '", _last(_K), "', wife of '", _first(_K + " + 2"), "' '",
          _last(_K + " + 4"), "', 022-'", pad(_K + " % 10000000", 7), "' Contact No: 98'",
          pad(_K + " % 100000000", 8), "' for '", pick(_K, _WORD), "' Limited '", pick(_K + " + 1", _WORD),
          "' Corporation'"),
    _text("'Ring +91 80123 45670 at noon or +91-80-2218-'", pad(_K + " % 10000", 4), "' or 9'",
          pad(_K + " % 1000000000", 9), "' or 020 '", pad(_K + " % 1000000", 6), "' today'"))
} as text from {{customer}}"""

ADDRESSES = f"""select {_S} as doc_id, {_by(
    _S,
    _text("'Registered Office: '", f"cast({_S} % 90 + 1 as string)", "' Fern Lane, Plot '",
          f"cast({_S} % 30 + 1 as string)", "', '", pick(_S, _CITY), "' 395'", pad(_S + " % 1000", 3),
          "', India; end'"),
    _text("'Stores 7/2, 7/'", f"cast({_S} % 9 + 1 as string)", "', 9/4 Old Mill Marg near Salt Depot '",
          pick(_S, _CITY), "' – 302 '", pad(_S + " % 1000", 3), "' Rajasthan, India Phone: 0141'"),
    _text("'Block C, Building No. '", f"cast({_S} % 9 + 1 as string)", "' Tamarind Court, Quay Street, '",
          pick(_S, _CITY), "' 395 '", pad(_S + " % 1000", 3), "' Telephone'"),
    _text("'Mailing Address: Flat "
          "', "f"cast({_S} % 99 as string)", "', Banyan Lane, '", pick(_S, _CITY), "' and more; Road to 12'"),
    _text("'A choir sang on March 3, 2019 near Sector '", f"cast({_S} % 30 as string)",
          "' before 250 guests who bought 395006 tickets.'"),
    _text("'Office Address: '", f"cast({_S} % 500 as string)", "', Unit 6, Weaver Yard (East), '",
          pick(_S, _CITY), "' 395 '", pad(_S + " % 1000", 3), "' (India) Contact'"))
} as text from {{supplier}}"""

HOSTS = f"""select {_E} as doc_id, {_by(
    _E,
    _text("'host 10.'", f"cast({_E} % 300 as string)", "'.'", f"cast({_E} % 7 as string)", "'.'",
          f"cast(user_id % 256 as string)"),
    _text("'release v10.'", f"cast({_E} % 20 as string)", "'.3.'", f"cast({_E} % 9 as string)"),
    _text("'peer at 192.168.'", f"cast({_E} % 256 as string)", "'.'", f"cast(user_id % 256 as string)",
          "' and 10.0.0.'", f"cast({_E} % 400 as string)"),
    _text("'node 0"
          "', "f"cast({_E} % 90 + 10 as string)", "'.1.1.1 then 172.16.'", f"cast(user_id % 300 as string)", "'.9'"),
    _text("'server '", f"cast({_E} % 256 as string)", "'.1.2.3; from 8.8.'", f"cast({_E} % 256 as string)", "'.8'"))
} as text from {{events}}"""

GUARDS = f"""select {_K} as doc_id, {_by(
    _K,
    _text("'Total ₹98'", pad(_K + " % 100000000", 8), "' paid to 97'", pad(_K + " % 100000000", 8)),
    _text("'Allotted shares 98'", pad(_K + " % 100000000", 8), "' at USD 91'", pad(_K + " % 100000000", 8)),
    "'Section 12 Limited'",
    _text("'The Limited, the Stock Exchange. The '", pick(_K, _WORD), "' Limited'"),
    _text("'Companies Act Limited, '", "'Private Limited'"),
    _text("'Managing Director: made pursuant to Regulation. Director of the Company '", _last(_K)),
    _text("'Promoter: Risk Factors; Partner: Asha Holdings Limited. Chairman: '", _first(_K), "' '", _last(_K)),
    _text("'hotel 98'", pad(_K + " % 100000000", 8), "' Tel: 12 34; Tel: 1234567,. Mob: '", pad(_K, 9)),
    _text("'Rs. 98'", pad(_K + " % 100000000", 8), "' $98'", pad(_K + " % 100000000", 8), "' ok 98'",
          pad(_K + " % 100000000", 8)))
} as text from {{customer}}"""

PROMOTERS = f"""select {_S} as doc_id, {_text(
    "'OUR PROMOTERS: '", _first(_S), "' '", _last(_S), "', '", _first(_S + " + 1"), "' '",
    _last(_S + " + 1"), "' and '", _first(_S + " + 2"), "' '", _last(_S + " + 2"),
    "', Risk Factors. Later '", _first(_S), "' '", _last(_S), "' met '", _first(_S + " + 2"), "' '",
    _last(_S + " + 2"), "'; our promoter '", _first(_S + " + 3"), "' '", _last(_S + " + 3"), "'.'")
} as text from {{supplier}}"""

KNOWN = f"""select {_S} as doc_id, {_by(
    _S,
    _text("'Notes by ASHA RAO and meera miller for '", pick(_S, _WORD), "' Ltd'"),
    _text("'Coral Bay traders llp, then Hazel & Finch and Juniper N.A. or Juniper N.A.x '", _last(_S)),
    _text("'Northlights is not northlight; Jonas Brandt-Asha Rao '", f"cast({_S} as string)"))
} as text from {{supplier}}"""

TEXTS = {
    "fx_ids": (IDS, "customer"),
    "fx_contacts": (CONTACTS, "customer"),
    "fx_addresses": (ADDRESSES, "supplier"),
    "fx_hosts": (HOSTS, "events"),
    "fx_guards": (GUARDS, "customer"),
    "fx_promoters": (PROMOTERS, "supplier"),
    "fx_known": (KNOWN, "supplier"),
}

# Blocks reached twice, as paragraphs of merged cells are.
DUP_BLOCKS = """select doc_id, block_id, concat('cell ', cast(doc_id as string), '/', cast(block_id as string)) as text
from (select l_orderkey as doc_id, cast(l_linenumber as bigint) as block_id from {lineitem}
      union all select l_orderkey, cast(l_linenumber as bigint) from {lineitem} where l_linenumber % 2 = 1) t"""

_RUNS = (
    ("'Contact Person: '", "true", "false"),
    (_text(_first(_K), "' '"), "false", "true"),
    (_last(_K), "true", "true"),
    (_text("', mail '", f"lower({_first(_K)})", "'.'"), "false", "false"),
    ("'mid'", "true", "false"),
    (_text(f"cast({_K} as string)", "'@mail.example.org; '"), "false", "true"),
    ("''", "true", "true"),
    (_text("'write to a@b.example.org or use 10.0.'", f"cast({_K} % 256 as string)", "'.7 now'"), "false", "false"),
)
RUNS = "\nunion all ".join(
    f"select {_K} as doc_id, {i} as run_id, {text} as text, {bold} as bold, {italic} as italic from {{customer}}"
    for i, (text, bold, italic) in enumerate(_RUNS)
)
_SINGLE_RUNS = (
    (_text("'Mail '", f"lower({_last(_K)})", "'@mail.example.org and '", f"lower({_first(_K)})",
           "'@desk.example.org now, '"), "true", "false"),
    (_text("'then call Tel: +91 98'", pad(_K + " % 100000000", 8)), "false", "true"),
    ("' and stop.'", "false", "false"),
)
SINGLE_RUNS = "\nunion all ".join(
    f"select {_K} as doc_id, {i} as run_id, {text} as text, {bold} as bold, {italic} as italic from {{customer}}"
    for i, (text, bold, italic) in enumerate(_SINGLE_RUNS)
)

# Labelled cases: one type, one text and the values expected in it.
CASES = f"""select {_K} as case_id, {pick(_K, ("FULL_NAME", "EMAIL", "PHONE", "COMPANY", "ADDRESS", "SSN",
    "CREDIT_CARD", "DOB", "IP_ADDRESS"))} as pii_type, {_by(
    _K,
    _text(f"case when {_K} % 4 = 0 then 'Yesterday ' else 'Chairman: ' end", _first(_K), "' '", _last(_K)),
    _text("'Write to '", f"lower({_last(_K)})", "'@mail.example.org.'"),
    _text("'Telephone: +91 80 2218 '", pad(_K + " % 10000", 4)),
    _text(pick(_K, _WORD), "' Metals Private Limited mends the bells.'"),
    _text("'Registered Office: '", f"cast({_K} % 90 + 1 as string)", "' Fern Lane, Pune 395'", pad(_K + " % 1000", 3)),
    _text("'SSN '", pad(_K + " * 7 % 1000", 3), "'-41-7782'"),
    _text("'Card 4012 8888 8888 188'", f"cast({_K} % 2 as string)"),
    _text("'DOB: 09/11/'", f"cast(1950 + {_K} % 50 as string)"),
    _text("'Lamp at 172.20.4.'", f"cast({_K} % 300 as string)"))} as text,
 {_by(
    _K,
    _text(_first(_K), "' '", _last(_K)),
    _text(f"lower({_last(_K)})", "'@mail.example.org'"),
    _text("'+91 80 2218 '", pad(_K + " % 10000", 4)),
    _text(pick(_K, _WORD), "' Metals Private Limited'"),
    _text(f"cast({_K} % 90 + 1 as string)", "' Fern Lane, Pune 395'", pad(_K + " % 1000", 3)),
    _text(pad(_K + " * 7 % 1000", 3), "'-41-7782'"),
    _text("'4012 8888 8888 188'", f"cast({_K} % 2 as string)"),
    _text("'09/11/'", f"cast(1950 + {_K} % 50 as string)"),
    _text("'172.20.4.'", f"cast({_K} % 300 as string)"))} as expected
from {{customer}}"""

def _beyond_limits() -> list[str]:
    """Texts that lie just outside a rule's limit, or on it, as the key runs."""
    k = _K
    quad = _text(f"cast({k} % 256 as string)", "'.'", f"cast({k} * 3 % 256 as string)", "'.0.'", f"cast(250 + {k} % 12 as string)")
    ssn = [_text(pad(f"{k} * 31 % 899 + 1", 3), "'-'", pad(f"{k} % 99 + 1", 2), "'-'", pad(f"{k} * 17 % 9999 + 1", 4))]
    for part in range(3):  # one part of it out of range
        parts = [pad(f"{k} % 665 + 1", 3), pad(f"{k} % 99 + 1", 2), pad(f"{k} % 9999 + 1", 4)]
        parts[part] = (_by(k + " + 1", "'000'", "'666'", pad(f"900 + {k} % 100", 3)), "'00'", "'0000'")[part]
        ssn.append(_text(parts[0], "'-'", parts[1], "'-'", parts[2]))
    run = f"substring('8123456790123456789', 1, cast(({{}}) as int))"
    return [
        *ssn[1:],
        _text("'v'", f"repeat('x', cast({k} % {2 * fv.VERSION_WINDOW} as int))", "' '", quad),
        _text("'₹'", f"repeat(' ', cast({k} % {2 * fv.CURRENCY_WINDOW} as int))", run.format(fv.PHONE_STANDALONE_DIGITS[0])),
        _text("'n '", run.format(f"{k} % 4 + {fv.PHONE_STANDALONE_DIGITS[0]} - 4")),
        _text("'n '", run.format(f"{k} % 4 + {fv.PHONE_STANDALONE_DIGITS[1]} + 1")),
        _text("'Tel: '", run.format(f"{k} % 3 + {fv.PHONE_CONTEXT_DIGITS[0]} - 3")),
        _text("'40'", pad(f"{k} * 7919", 10), "'0000'"),
        _text("'Address: '", f"repeat('q', cast({k} % {fv.ADDRESS_CONTEXT_MIN_LENGTH} as int))", "' 395006'"),
        _text("'Address: '", quad),
    ]


NEGATIVES = f"select {_K} as case_id, {_by(_K, *_beyond_limits())} as text from {{customer}}"

# Labelled passages: the contact texts with their true values, some of them written
# differently from the text or not present at all.
TRUTH = "\nunion all ".join(
    f"select {_K} as passage_id, {i} as truth_idx, '{kind}' as pii_type, {value} as value from {{customer}}"
    for i, (kind, value) in enumerate((
        ("FULL_NAME", _text(_first(_K), "' '", _last(_K))),
        ("FULL_NAME", _text("'Mx '", f"upper({_last(_K + ' + 5')})", "', '", _first(_K + " + 3"))),
        ("COMPANY", _text(pick(_K, _WORD), "' '", pick(_K, ("Traders LLP", "Metals Private Limited",
                          "Power Limited", "Foods", "None", "Limited", "Missing")))),
        ("PHONE", _text("'98'", pad(_K + " % 100000000", 8))),
        ("EMAIL", _text(f"lower({_first(_K)})", "'.'", f"lower({_last(_K)})", "'@mail.example.org'")),
    ))
)


# A chain of cells for each customer, depths 0 to c_custkey % 7, and a second cell beside each.
NESTED_CELLS = "\nunion all ".join(
    f"select {_K} as doc_id, {2 * d + side} as cell_id, {2 * d - 2 if d else 'null'} as parent_id, "
    f"{d} as row, {side} as col, {_text(pick(_K + f' + {d}', _WORD), 'chr(10)', f'cast({_K} as string)') if side else pick(_K + f' + {d}', _CITY)} as text "
    f"from {{customer}} where {_K} % 7 >= {d}"
    for d in range(7) for side in range(2)
)


def _json(*parts: str) -> str:
    """JSON written by concat, with ` for quotation marks, and < and > for braces."""
    return f"translate({_text(*parts)}, '`<>', chr(34) || chr(123) || chr(125))"


# Parts of documents as JSON: a body with a table in a table, headers of which some are damaged or missing, footers.
PARTS = f"""select {_K} as doc_id,
  {_json("'<`paragraphs`:[`Contact Person: '", _first(_K), "' '", _last(_K), "'`,` `],`cells`:['",
         "'<`cell_id`:1,`row`:0,`col`:2,`text`:`mail u'", f"cast({_K} as string)", "'@mail.example.org`>,'",
         "'<`cell_id`:2,`parent_id`:1,`row`:1,`col`:0,`text`:`host 10.1.2.'", f"cast({_K} % 250 as string)", "'`>]>'")} as body,
  case {_K} % 4 when 0 then null when 1 then {_json("'<`paragraphs`:['")} when 2 then '[7]'
    else {_json("'<`paragraphs`:[`head '", f"cast({_K} as string)", "'`]>'")} end as header,
  {_json("'<`cells`:[<`cell_id`:9,`row`:'", f"cast({_K} % 3 as string)", "',`col`:0,`text`:`SSN 321-45-'", pad(_K + " % 9000 + 1", 4), "'`>]>'")} as footer
from {{customer}}"""


# Letters on orders, and a dictionary of two thirds of the customers and of all suppliers in them.
LETTERS = f"""select o_orderkey as doc_id, o_custkey as customer, o_orderkey % 7 + 1 as supplier, {_text(
    "'Note '", "cast(o_orderkey as string)", "': PARTNER'", "cast(o_custkey as string)",
    "' Varga pays House'", "cast(o_orderkey % 7 + 1 as string)", "' of oak, not Partner of oak nor House Varga.'")} as text
from {{orders}}"""
LETTER_TERMS = f"""select 'name' as kind, {_text("'Partner'", f"cast({_K} as string)", "' varga'")} as term
from {{customer}} where {_K} % 3 > 0
union all select 'company', {_text("'House'", f"cast({_S} as string)", "' of Oak'")} from {{supplier}}"""


def run_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A shared query over the parquet tables it names, their rows dealt evenly to tasks."""
    names = [n for n in ("customer", "supplier", "events", "lineitem", "orders") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: dealt(table(spark, folder, n)) for n in names})


def first_name() -> str:
    return _first(_K)


def last_name() -> str:
    return _last(_K)


def plain(sql: str) -> str:
    """The same query over tables known by their own names."""
    return sql.format(customer="customer", supplier="supplier", events="events", lineitem="lineitem", orders="orders")
