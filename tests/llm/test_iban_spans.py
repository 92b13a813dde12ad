"""IBANs whose digits pass as a card, or that words and other IBANs follow, are found."""

from issuetime.llm import pii


def belgian():
    """The first Belgian IBANs by number whose 14 digits also pass Luhn."""
    for n in range(539_007_547_034, 539_007_549_034):
        check = 98 - int(f"{n}111400") % 97
        if pii.luhn(f"{check:02d}{n}"):
            yield f"BE{check:02d}{n}"


def test_iban_over_a_card():
    some = list(belgian())
    assert len(some) > 50
    for iban in some:
        for shown in (iban, " ".join(iban[i : i + 4] for i in range(0, 16, 4))):
            text = f"iban {shown} today"
            spans = [x[:3] for x in pii.find_spans(text)]
            assert ("iban", 5, 5 + len(shown)) in spans and any(x[0] == "card" for x in spans)
            assert pii.redact(text) == "iban <iban> today"
            assert pii.base_spans(text) == [x for x in spans if x[0] in pii.BASE_KINDS]


def test_iban_before_upper_case_words():
    iban, other = "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"
    for tail in ("BIC X", "A", "CODE", "ANTWERP", "BIC KREDBEBB"):
        assert ("iban", 5, 5 + len(iban)) in [x[:3] for x in pii.find_spans(f"IBAN {iban} {tail}")], tail
    found = [x[1:3] for x in pii.find_spans(f"{iban} {other}") if x[0] == "iban"]
    assert found == [(0, len(iban)), (len(iban) + 1, len(iban) + 1 + len(other))]
    assert not [x for x in pii.find_spans("IBAN BE68 5390 0754 7035 BIC") if x[0] == "iban"]
