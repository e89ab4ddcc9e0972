"""A slow oracle for the text rules: the fixed patterns with Python's own regex engine."""

import re

from maskwright.functions import fixed_values as fv

B = r"\b"
SINGLE = {
    "email": (B + fv.EMAIL + B, 0, 0),
    "ssn": (B + fv.SSN + B, 0, 0),
    "card": (rf"\b{fv.CARD_GROUPED}\b|\b{fv.CARD_PLAIN}\b", 0, 0),
    "ipv4": (B + fv.IPV4 + B, 0, 0),
    "dob": (fv.DOB, 1, re.I),
    "phone_context": (fv.PHONE_CONTEXT, 1, re.I),
    "phone_standalone": (rf"{fv.PHONE_MOBILE}\b|{fv.PHONE_INTERNATIONAL}\b|\b{fv.PHONE_LANDLINE}\b", 0, 0),
    "address_context": (fv.ADDRESS_CONTEXT, 1, re.I),
    "address_pattern": (
        rf"\b(?:(?:{fv.ADDRESS_LEAD_NUMBER}|{fv.ADDRESS_LEAD_BUILDING})\s*,?\s*)?(?:{fv.ADDRESS_FREE}+)?"
        rf"{fv.ADDRESS_THOROUGHFARE}{fv.ADDRESS_MIDDLE}+"
        rf"(?:\b{fv.ADDRESS_PIN_SOLID}\b|\b{fv.ADDRESS_PIN_SPLIT}\b)[,\s]*(?:{fv.ADDRESS_TAIL}+)?",
        0, re.I,
    ),
    "company_suffix": (
        rf"\b({fv.COMPANY_TOKEN}(?:\s+{fv.COMPANY_TOKEN}){{0,{fv.COMPANY_EXTRA_TOKENS}}}\s+{fv.COMPANY_SUFFIX})\b",
        1, 0,
    ),
    "name_salutation": (B + fv.NAME_SALUTATION + fv.NAME_WORDS + B, 1, 0),
    "name_role": (fv.NAME_ROLE + fv.NAME_WORDS, 1, re.I),
    "name_phrase": (B + fv.NAME_PHRASE + fv.NAME_WORDS + B, 1, re.I),
}


def raw(rule, text):
    """Matches before any guard: (start, end, value)."""
    pattern, group, flags = SINGLE[rule]
    return [(m.start(group), m.end(group), m.group(group)) for m in re.finditer(pattern, text, flags)]


def digit_count(value):
    return sum(c.isdecimal() for c in value)


def luhn(value):
    ds = [int(c) for c in value if c.isdecimal()]
    odd = ds[-1::-2]
    even = [sum(divmod(2 * d, 10)) for d in ds[-2::-2]]
    return 13 <= len(ds) <= 19 and (sum(odd) + sum(even)) % 10 == 0


def shorter(hit, value):
    at = hit[2].index(value) if value else 0
    return hit[0] + at, hit[0] + at + len(value), value


def name_fits(value):
    return (
        value not in fv.NAME_STOPS
        and value.split()[0].lower() not in fv.NON_NAME_FIRST_WORDS
        and not [t for t in fv.NAME_LEGAL_TOKENS if t in value]
    )


def address(hit):
    text = hit[2].strip()
    cut = text
    for term in fv.CONTACT_TERMS:
        if cut.endswith(term):
            cut = cut.removesuffix(term).strip()
    if cut != text:
        return shorter(hit, cut.rstrip(fv.TRAILING_PUNCTUATION))
    trimmed = hit[2].rstrip(fv.TRAILING_PUNCTUATION)
    return shorter(hit, trimmed if trimmed != hit[2] else text)


def spans(rule, text):
    """What the rule should report, in text order."""
    hits = raw(rule, text)
    if rule == "card":
        return [h for h in hits if luhn(h[2])]
    if rule == "ipv4":
        def octets(v):
            return all(o == str(int(o)) and int(o) < 256 for o in v.split("."))
        return [h for h in hits if "v" not in text[max(h[0] - 8, 0):h[0]].lower() and octets(h[2])]
    if rule == "phone_context":
        kept = [h for h in hits if 7 <= digit_count(h[2]) <= 15]
        return [(s, s + len(v.rstrip(fv.TRAILING_PUNCTUATION)), v.rstrip(fv.TRAILING_PUNCTUATION)) for s, _, v in kept]
    if rule == "phone_standalone":
        kept = []
        for h in hits:
            window = text[max(h[0] - 10, 0):h[0]]
            if 10 <= digit_count(h[2]) <= 15 and not [t for t in fv.CURRENCY_TOKENS if t in window]:
                kept.append(shorter(h, h[2].strip()))
        return kept
    if rule == "address_context":
        cut = [(s, s + len(v.rstrip(fv.TRAILING_PUNCTUATION)), v.rstrip(fv.TRAILING_PUNCTUATION)) for s, _, v in hits]
        return [h for h in cut if len(h[2]) >= 15]
    if rule == "address_pattern":
        return [h for h in map(address, hits) if len(h[2]) >= 20]
    if rule == "company_suffix":
        kept = []
        for h in hits:
            value = h[2].strip()
            bare = value.startswith("The ") and len(value.split()) == 2
            if value not in fv.COMPANY_STOPS and not value.startswith(fv.COMPANY_BAD_PREFIXES) and not bare:
                kept.append(shorter(h, value))
        return kept
    if rule.startswith("name_"):
        return [h for h in hits if name_fits(h[2])]
    return hits


def promoters(text):
    out = []
    names = []
    for m in re.finditer(fv.PROMOTER_LIST, text, re.I):
        for part in re.split(r",|\band\b", m.group(1)):
            name = part.strip()
            if name and 2 <= len(name.split()) <= 4 and name not in names:
                if name not in fv.NAME_STOPS and name.split()[0].lower() not in fv.NON_NAME_FIRST_WORDS:
                    names.append(name)
    for name in names:
        out += [(m.start(), m.end(), name) for m in re.finditer(re.escape(name), text)]
    return out


def sweep(candidates):
    """Greedy overlap resolution over (start, end, order, ...)."""
    kept, reach = [], -1
    for c in sorted(candidates, key=lambda c: (c[0], c[0] - c[1], c[2])):
        if c[0] >= reach:
            kept.append(c)
            reach = c[1]
    return kept
