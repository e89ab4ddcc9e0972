"""Regex dialects: the fixed patterns, spelled for the JVM and for RE2.

Detection has to treat every alphabet alike: ``\\s`` is any Unicode blank, ``\\d``
any decimal digit and a word character any letter, number or underscore.  The
JVM's shorthands are ASCII by default and changed between JDKs, so they are
spelled out here as explicit classes and lookarounds.

``java(...)`` builds patterns for Spark; ``re2(...)`` builds the plain form that
SQL engines with an RE2 dialect accept (no lookaround), used by the check SQL.
"""

from __future__ import annotations

from . import fixed_values as fv

# Unicode blanks, as the inside of a character class
BLANKS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_WORD = r"[\p{L}\p{N}_]"

# word boundaries: next to a character known to be a word character, or in general
WORD_START = rf"(?<!{_WORD})"
WORD_END = rf"(?!{_WORD})"
# the same before a digit or one of some letters; testing that first is much faster
DIGIT_START = rf"(?=\p{{Nd}}){WORD_START}"
BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _expand(pattern: str) -> str:
    """Spell ``\\s`` and ``\\d`` as Unicode classes, inside and outside brackets."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(BLANKS if in_class else f"[{BLANKS}]")
            i += 2
        elif pair == r"\d":
            out.append(r"\p{Nd}")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            if pair[0] in "[]":
                in_class = pair[0] == "["
            out.append(pair[0])
            i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iu)" if ignore_case else "") + _expand(pattern)


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _expand(pattern)


def escape(literal: str) -> str:
    """Quote a literal for either dialect."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() and c != "_" else c for c in literal)


def starting(letters: str, pattern: str) -> str:
    """The pattern with a quick test of its first letter in front."""
    return f"(?=[{letters}]){pattern}"


def _folding() -> tuple[str, str]:
    """Letters that lower-casing alone leaves apart from others they equal if case is ignored.

    The regex engine compares letters by the lower case of their upper case; so this maps the
    letters for which that differs from their lower case.
    """
    letters, to = [], []
    for c in map(chr, range(0x80, 0x10000)):
        upper = c.upper() if len(c.upper()) == 1 else c
        both = upper.lower()[0]
        if c.isalpha() and both != c.lower():
            letters.append(c)
            to.append(both)
    return "".join(letters), "".join(to)


FOLD_FROM, FOLD_TO = _folding()


def fold(text: str) -> str:
    """Text in which letters that are equal when case is ignored are the same."""
    return text.translate(dict(zip(map(ord, FOLD_FROM), FOLD_TO))).lower()


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


# --- JVM forms --------------------------------------------------------------------------
# A run of local characters is walked once: it is entered at its start (or where the match
# before ended), skips to its first possible start of a local part, and stays with that one,
# since all starts of a run share its end.  Group 1 is what was skipped, group 2 the hit.  A local part may start with one of .%+- only right
# after a word character.
_LOCAL, _DOMAIN = fv.EMAIL.split("+@")
EMAIL = java(
    rf"(?:\G|(?<!{_LOCAL}))((?>{_LOCAL}*?(?={WORD_START}[A-Za-z0-9_]|(?<={_WORD})[.%+-])))"
    rf"({_LOCAL}++@{_DOMAIN}{WORD_END})"
)
SSN = java(DIGIT_START + fv.SSN + WORD_END)
CARD = java(rf"{DIGIT_START}(?:{fv.CARD_GROUPED}|{fv.CARD_PLAIN}){WORD_END}")
IPV4 = java(DIGIT_START + fv.IPV4 + WORD_END)
DOB = java(starting("BD", fv.DOB), ignore_case=True)
PHONE_CONTEXT = java(starting("CFMPT", fv.PHONE_CONTEXT), ignore_case=True)
PHONE_STANDALONE = java(
    rf"{fv.PHONE_MOBILE}{WORD_END}"
    rf"|{fv.PHONE_INTERNATIONAL}{BOUNDARY}"
    rf"|{DIGIT_START}{fv.PHONE_LANDLINE}{WORD_END}"
)
# If the text behind a header holds no place up to the end of its clause, no header further
# on in the clause can do better, unless its own blanks or point leave the clause.  So a
# header without a place takes what follows with it, up to such a header; group 1 is empty then.
_HEADER, _PLACE = fv.ADDRESS_CONTEXT.split(r"[\s:]+", 1)
_HEADER_INSIDE = _HEADER.replace(r"|Regd\.\s+Office", "").replace(r"\s+", r"(?:(?!\n)\s)+")
_HEADER_LEAVING = rf"(?=[ABCMOR])(?={_HEADER}[\s:])(?!{_HEADER_INSIDE}(?:(?!\n)[\s:])++[^\n])"
ADDRESS_CONTEXT = java(
    starting("ABCMOR", rf"{_HEADER}(?:[\s:]+{_PLACE}|[\s:]+(?:(?!{_HEADER_LEAVING})[^\n;.])*+)"),
    ignore_case=True,
)
PIN = java(
    rf"{DIGIT_START}(?:{fv.ADDRESS_PIN_SOLID}|{fv.ADDRESS_PIN_SPLIT}){WORD_END}"
)
# Blanks and token characters exclude each other, so possessive quantifiers find
# the same spans, and one attempt for each run of token characters is enough: from its first
# word boundary, since what follows the run is the same for all of them.  Group 1 is what comes
# before that boundary, group 2 the hit.
COMPANY_SUFFIX_HIT = java(rf"\s{fv.COMPANY_SUFFIX}{BOUNDARY}")
_TOKEN = fv.COMPANY_TOKEN.removesuffix("*")
COMPANY_SUFFIX = java(
    rf"(?:\G|(?<!{_TOKEN}))((?>{_TOKEN}*?(?={BOUNDARY})))({fv.COMPANY_TOKEN}+"
    rf"(?:\s++{fv.COMPANY_TOKEN}+){{0,{fv.COMPANY_EXTRA_TOKENS}}}"
    rf"\s+{fv.COMPANY_SUFFIX}{BOUNDARY})"
)
NAME_SALUTATION = java(
    starting("DMPS", WORD_START + fv.NAME_SALUTATION + fv.NAME_WORDS + WORD_END)
)
NAME_ROLE = java(starting("CDEIMNPW", fv.NAME_ROLE + fv.NAME_WORDS), ignore_case=True)
NAME_PHRASE = java(
    starting("ABDNSW", WORD_START + fv.NAME_PHRASE + fv.NAME_WORDS + WORD_END), ignore_case=True
)
PROMOTER_LIST = java(fv.PROMOTER_LIST, ignore_case=True)
PROMOTER_SEPARATOR = java(rf",|{WORD_START}and{WORD_END}")

# Every character an address can contain is in ADDRESS_MIDDLE, so an address lies
# inside one unbroken run of those characters, ends with the run's last PIN and its
# tail, and there is at most one per run.  The JVM form walks each run once: group 1
# is what precedes the first thoroughfare word, group 2 the rest of the address.
# A run without an address leaves group 2 empty and is dropped.
ADDRESS_RUN = java(
    rf"{BOUNDARY}(?={fv.ADDRESS_MIDDLE})"
    rf"((?:(?!{fv.ADDRESS_THOROUGHFARE}){fv.ADDRESS_MIDDLE})*+)"
    rf"(?:({fv.ADDRESS_THOROUGHFARE}{fv.ADDRESS_MIDDLE}+{PIN}[,\s]*+(?:{fv.ADDRESS_TAIL})*+)"
    rf"|({fv.ADDRESS_MIDDLE}*+))",
    ignore_case=True,
)
# The address starts at the first word boundary of the unbroken ADDRESS_FREE text
# before that word, or further left at a number joined to it through slashes.
ADDRESS_FREE_END = java(rf"(?<!{fv.ADDRESS_FREE}){fv.ADDRESS_FREE}*+\z", ignore_case=True)
ADDRESS_SLASHED_END = java(r"(?<![/,\-A-Za-z0-9\s])[/,\-A-Za-z0-9\s]*+\z", ignore_case=True)
ADDRESS_NUMBER_ON = java(rf"(?s){WORD_START}[0-9].*\z")
ADDRESS_NON_WORD_START = java(r"\A[\s,\-()]*+")

# --- RE2 forms (whole patterns, ASCII word boundaries) ------------------------------------
_B = r"\b"
RE2 = {
    "email": (re2(_B + fv.EMAIL + _B), 0),
    "ssn": (re2(_B + r"\d{3}-\d{2}-\d{4}" + _B), 0),
    "card": (re2(rf"\b{fv.CARD_GROUPED}\b|\b{fv.CARD_PLAIN}\b"), 0),
    "ipv4": (re2(_B + fv.IPV4 + _B), 0),
    "dob": (re2(fv.DOB, True), 1),
    "phone_context": (re2(fv.PHONE_CONTEXT, True), 1),
    "phone_standalone": (
        re2(rf"{fv.PHONE_MOBILE}\b|{fv.PHONE_INTERNATIONAL}\b|\b{fv.PHONE_LANDLINE}\b"), 0),
    "address_context": (re2(fv.ADDRESS_CONTEXT, True), 1),
    "address_pattern": (
        re2(
            rf"\b(?:(?:{fv.ADDRESS_LEAD_NUMBER}|{fv.ADDRESS_LEAD_BUILDING})\s*,?\s*)?"
            rf"(?:{fv.ADDRESS_FREE}+)?{fv.ADDRESS_THOROUGHFARE}{fv.ADDRESS_MIDDLE}+"
            rf"(?:\b{fv.ADDRESS_PIN_SOLID}\b|\b{fv.ADDRESS_PIN_SPLIT}\b)[,\s]*(?:{fv.ADDRESS_TAIL}+)?",
            True,
        ),
        0,
    ),
    "company_suffix": (
        re2(
            rf"\b({fv.COMPANY_TOKEN}(?:\s+{fv.COMPANY_TOKEN}){{0,{fv.COMPANY_EXTRA_TOKENS}}}"
            rf"\s+{fv.COMPANY_SUFFIX})\b"
        ),
        0,
    ),
    "name_salutation": (re2(_B + fv.NAME_SALUTATION + fv.NAME_WORDS + _B), 1),
    "name_role": (re2(fv.NAME_ROLE + fv.NAME_WORDS, True), 1),
    "name_phrase": (re2(_B + fv.NAME_PHRASE + fv.NAME_WORDS + _B, True), 1),
    "name_promoters": (re2(fv.PROMOTER_LIST, True), 1),
}
