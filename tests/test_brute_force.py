"""Every text rule against Python's regex engine on random texts of telling pieces."""

import random

import pytest

import brute
from maskwright.functions import fixed_values as fv

PIECES = [
    " ", " ", " ", " ", "  ", "\n", ", ", ". ", "; ", "/", "-", " – ", "(", ")", "&", ":", "\t", " ", "é", "_", "'", "@", "+",
    "Road", "Lake", "12", "411003", "400 051", "India", "Sector", "Plot", "Towers", "Park", "Pune", "Tel", "Telephone:", "Contact",
    "Registered Office:", "Address", "B-7", "11/3", "No.", "Limited", "Ltd.", "Pvt. Ltd.", "Private", "LLP", "Inc", "Corp.", "The",
    "Section", "Companies Act", "Global", "Asha Rao", "Ravi", "Mr.", "Dr.", "Shri", "Director", "Managing Director:", "Chairman and",
    "being", "son of", "namely", "made", "Risk Factors", "OUR PROMOTERS:", "and", "Promoter", "+91", "9876543210", "020", "22881234",
    "(20)", "6729 5100", "₹", "Rs.", "$", "shares", "Mob No", "Fax", "a.b", "mail@x.org", "%x", "example.com", "123-45-6789",
    "000-12-3456", "4111 1111 1111 1111", "4111111111111111", "5105-1051-0510-5100", "10.0.0.1", "192.168.1.256", "v", "server",
    "1.2.3.4", "01.2.3.4", "DOB", "Born", "14/08/1998", "14th Aug 98", "August 14, 1998", "Date of Birth", "٣", "quint", "\x01", "ſ",
]


def texts(seed, n, low, high):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(low, high))) for _ in range(n)})


def address_texts(seed, n):
    """Texts dense in what addresses are made of."""
    rng = random.Random(seed)
    pieces = ["Road", "Lane", "park", "12", "7/9", "/", " ", " ", ",", "-", "–", ".", "(", ")", "&", "411003", "400 051", "123 456",
              "Ab", "é", "_", "\n", "Tel", "Email", "India", ";", "9", "Tower", "x"]
    return sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(3, 22))) for _ in range(n)})


@pytest.fixture(scope="module")
def samples():
    return texts(1, 1500, 2, 14) + texts(2, 300, 15, 50) + address_texts(3, 3000)


@pytest.fixture(scope="module")
def candidates(found, samples):
    return found(samples, all_candidates=True)


@pytest.mark.parametrize("rule", sorted(brute.SINGLE))
def test_rule_equals_brute_force(candidates, samples, rule):
    seen = 0
    for text in samples:
        got = [(s, e, v) for _, r, s, e, v in candidates[text] if r == rule]
        assert got == brute.spans(rule, text), (rule, text)
        seen += len(got)
    assert seen > 5


def test_promoter_lists(candidates, samples):
    seen = 0
    for text in samples:
        got = [(s, e, v) for _, r, s, e, v in candidates[text] if r == "name_promoters"]
        assert got == brute.promoters(text), text
        seen += len(got)
    assert seen > 5


def test_values_stand_at_their_offsets(candidates):
    for text, spans in candidates.items():
        for _, rule, s, e, v in spans:
            assert text[s:e] == v, (rule, text)


def test_resolution(found, samples, candidates):
    order = {rule: i for i, (rule, _) in enumerate(fv.RULES)}
    resolved = found(samples)
    for text in samples:
        want = brute.sweep([(s, e, order[r], t, r, v) for t, r, s, e, v in candidates[text]])
        assert [(s, e, order[r], t, r, v) for t, r, s, e, v in resolved[text]] == want, text
