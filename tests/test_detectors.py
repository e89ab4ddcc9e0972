"""The rules on single inputs, with exact spans, and what they must leave alone."""

import time

import pytest

from maskwright.functions import fixed_values as fv


def values(found, text, rule=None, **options):
    return [v for _, r, _, _, v in found([text], all_candidates=True, **options)[text] if rule in (None, r)]


DIGITS = "8123456790123456789012345"


def checked(body):
    """Digits with the one that makes their weighted sum a multiple of ten."""
    for last in "0123456789":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(body + last)))
        if total % 10 == 0:
            return body + last
    raise AssertionError


def limits():
    """(rule, text, value or None): on both sides of every limit of the rules."""
    for n in range(3, 20):
        low, high = fv.PHONE_CONTEXT_DIGITS
        spaced = " ".join(DIGITS[i : min(i + 3, n)] for i in range(0, n, 3))
        if 8 <= len(spaced) <= 20:
            yield "phone_context", f"Fax {spaced}", spaced if low <= n <= high else None
        low, high = fv.PHONE_STANDALONE_DIGITS
        one_start = "8" + "012345" * 4  # no other digit can begin a number
        yield "phone_standalone", f"n {one_start[:n]}", one_start[:n] if n == low else None
        low, high = fv.CARD_DIGITS
        good = checked(DIGITS[: n - 1])
        yield "card", f"n {good}", good if low <= n <= high else None
        yield "card", f"n {good[:-1]}{(int(good[-1]) + 1) % 10}", None
    for gap in range(2 * fv.CURRENCY_WINDOW):
        yield "phone_standalone", f"₹{' ' * gap}{DIGITS[:10]}", DIGITS[:10] if gap >= fv.CURRENCY_WINDOW else None
    for gap in range(1, 2 * fv.VERSION_WINDOW):
        yield "ipv4", f"V{'_' * (gap - 1)} 9.8.7.6", "9.8.7.6" if gap >= fv.VERSION_WINDOW else None
    for place in range(4):
        for octet in (0, 9, 99, 255, 256, 300, 999):
            quad = ".".join(str(octet if i == place else 31) for i in range(4))
            yield "ipv4", f"= {quad}", quad if octet < 256 else None
    for area, group, serial in [(a, 51, 7) for a in (0, 1, 665, 666, 667, 899, 900, 999)] + [(4, g, 1) for g in (0, 1, 99)] + [(4, 1, x) for x in (0, 1, 9999)]:
        number = f"{area:03d}-{group:02d}-{serial:04d}"
        yield "ssn", f"# {number} #", number if area not in (0, 666) and area < 900 and group and serial else None
    for n in range(6, 2 * fv.ADDRESS_CONTEXT_MIN_LENGTH):
        value = "q" * (n - 4) + "Pune"
        yield "address_context", f"Address: {value}", value if n >= fv.ADDRESS_CONTEXT_MIN_LENGTH and n > 4 else None
    for n in range(1, 7):
        names = " ".join(["Ilse", "Noor", "Pia", "Ugo", "Zoe", "Ann"][:n])
        yield "name_promoters", f"OUR PROMOTERS: {names}", names if fv.PROMOTER_WORDS[0] <= n <= fv.PROMOTER_WORDS[1] else None
    for anchor in ("DOB", "Date  of Birth", "BirthDate", "Born", "D.O.B.", "Wed", "Founded"):
        for date in ("1/2/34", "01-12-2003", "9th Jun, 1944", "May 7 1980", "7.5.1980", "1980/05/07"):
            known = anchor not in ("Wed", "Founded") and date not in ("7.5.1980", "1980/05/07")
            yield "dob", f"{anchor}: {date}", date if known else None
    for top in (1, 2, 7, 8):
        mail = f"ilse+1@host.{'z' * top}"
        yield "email", f"<{mail}>", mail if 2 <= top <= 7 else None


@pytest.fixture(scope="module")
def at_limits(found):
    return found([t for _, t, _ in limits()], all_candidates=True)


@pytest.mark.parametrize("rule", sorted({r for r, _, _ in limits()}))
def test_limits(at_limits, rule):
    wrong = []
    for r, text, want in limits():
        got = [v for _, found_by, _, _, v in at_limits[text] if found_by == rule]
        if r == rule and got != ([want] if want else []):
            wrong.append((text, want, got))
    assert not wrong


FORMS = ["Limited", "LIMITED", "Ltd", "Ltd.", "Pvt. Ltd.", "LLP", "Inc.", "Corporation", "CORP"]
LEADS = {
    "name_salutation": ["Mr.", "Ms.", "Mrs.", "Dr.", "Prof.", "Shri", "Smt."],
    "name_role": ["Chairman:", "Promoter", "Chairman & Executive Director", "Whole-time Director:", "Compliance Officer :"],
    "name_phrase": ["namely", "signed by", "daughter of", "designated as"],
}


MISSPELT = str.maketrans("rstn", "qqqq")


@pytest.mark.parametrize("rule", sorted(LEADS))
def test_names_follow_their_leads(found, rule):
    for lead in LEADS[rule]:
        assert values(found, f"{lead} Ilse Noor; and", rule) == ["Ilse Noor"]
        assert values(found, f"{lead.translate(MISSPELT)} Ilse Noor; and", rule) == []
        assert values(found, f"{lead} Ilse; and", rule) == []


def test_firms_end_in_their_form(found):
    for form in FORMS:
        assert [v.rstrip(".") for v in values(found, f"; Ochre Kiln {form}", "company_suffix")] == [f"Ochre Kiln {form}".rstrip(".")]
        assert values(found, f"; Ochre Kiln {form[:2]}q", "company_suffix") == []


def test_addresses_over_lines(found):
    lines = ["14, Tern Enclave", "Surat 395006", "Gujarat"]
    for n in range(1, 4):
        text = "\n".join(lines[:n])
        want = [text] if n > 1 else []
        assert values(found, text, "address_pattern") == want


def test_firms_are_not_names(found):
    assert values(found, "Partner: Blue Mesa Limited", "name_role") == []


def test_known_values(found):
    text = "Notes by ASHA RAO on northlight and Juniper N.A. or Juniper N.A.x, not Northlights"
    options = {"known_names": ["Asha Rao"], "known_companies": ["Northlight", "Juniper N.A."]}
    assert values(found, text, "name_known", **options) == ["ASHA RAO"]
    assert values(found, text, "company_known", **options) == ["Juniper N.A.", "northlight"]


def test_null_and_blank(spark):
    from maskwright.operators import redact as rd

    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "id int, text string")
    rows = {r.id: (r.text, r.n_redactions) for r in rd.redact_text(df, salt="s").collect()}
    assert rows == {1: (None, 0), 2: ("", 0), 3: (" \n", 0)}


def test_long_hostile_texts_take_bounded_time(found):
    words = "12/ Road (Sector 4), Plot - Address Office Lane Park 9, " * 600
    texts = [
        words,
        words + " Pune 411003, India",
        "a b c d e f g h i j " * 3000 + "Limited",
        "Tel" + " " * 3000 + "x",
        "Director " * 3000,
        "x  " * 8000 + "Inc",
        "1234 " * 6000,
    ]
    start = time.time()
    spans = found(texts, all_candidates=True)
    assert time.time() - start < 60
    assert [v[-12:] for _, r, _, _, v in spans[texts[1]] if r == "address_pattern"] == ["411003, India"[-12:]]
    assert [v for _, r, _, _, v in spans[texts[2]] if r == "company_suffix"] == ["c d e f g h i j Limited"]
