from __future__ import annotations

import datetime as dt
import random
import re
import time

import pytest
from common_llm import docs_table

from askahead.llm import pii
from askahead.llm.feistel import Permutation, Pseudonyms, iban_rest, luhn_sum, valid_ssn

KEY = b"a key for tests"
NAMES = Pseudonyms(KEY)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 100, 1000, 2600])
def test_permutations_move_every_value(size):
    p = Permutation(KEY, "t", size)
    image = [p.encrypt(i) for i in range(size)]
    assert sorted(image) == list(range(size))
    assert size == 1 or all(a != b for a, b in enumerate(image))
    assert [p.decrypt(x) for x in image] == list(range(size))
    if size > 90:
        assert image != [Permutation(b"other", "t", size).encrypt(i) for i in range(size)]
        assert image != [Permutation(KEY, "u", size).encrypt(i) for i in range(size)]


def with_check(digits):
    return digits + str(-luhn_sum(digits + "0") % 10)


def test_values_stay_valid_and_can_be_undone():
    rng = random.Random(1)
    for _ in range(200):
        card = with_check("".join(rng.choice("0123456789") for _ in range(15)))
        new = NAMES.card(card)
        assert luhn_sum(new) == 0 and new != card and NAMES.card(new, back=True) == card
        ssn = f"{rng.randint(1, 665):03d}{rng.randint(1, 99):02d}{rng.randint(1, 9999):04d}"
        assert valid_ssn(NAMES.ssn(ssn)) and NAMES.ssn(ssn) != ssn and NAMES.ssn(NAMES.ssn(ssn), back=True) == ssn
        day = dt.date(1900, 1, 1) + dt.timedelta(days=rng.randint(0, 70_000))
        assert NAMES.date(day) != day and NAMES.date(NAMES.date(day), back=True) == day
        octets = [rng.randint(0, 255) for _ in range(4)]
        assert NAMES.ipv4(octets) != octets and NAMES.ipv4(NAMES.ipv4(octets), back=True) == octets
    iban = "DE89370400440532013000"
    assert iban_rest(NAMES.iban(iban)) == 1 and NAMES.iban(iban) != iban and NAMES.iban(NAMES.iban(iban), back=True) == iban
    assert NAMES.name("x", NAMES.name("x", "Ann-M.07é"), back=True) == "Ann-M.07é"
    assert re.fullmatch(r"[A-Z][a-z]{2}-[A-Z]\.\d\dé", NAMES.name("x", "Ann-M.07é"))
    assert len({NAMES.card(with_check(f"{i:015d}")) for i in range(500)}) == 500
    with pytest.raises(ValueError):
        Pseudonyms(b"")


CARD = with_check("980791576280449")
FOUND = {
    "mail to ann.lee+x7@mail3.example.com today": ["email"],
    "host 97.51.17.173, and 0.0.0.0.": ["ipv4", "ipv4"],
    f"card {CARD} and {CARD[:4]} {CARD[4:8]} {CARD[8:12]} {CARD[12:]}": ["card", "card"],
    "call +1 (017) 555-7713 or 017-555-7713 or (017) 555-7713": ["phone", "phone", "phone"],
    "born 1987-03-12, 12.03.1987, 12/31/1987, 3/4/2001": ["date"] * 4,
    "ssn 123-45-6789": ["ssn"],
    "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000": ["iban", "iban"],
    "+4915112345678": ["phone"],
    f"97.51.17.173 {CARD} +1 (017) 555-7713\n1999-12-31": ["ipv4", "card", "phone", "date"],
}
LEFT = [
    "", "no numbers", "256.1.1.1 and 1.2.3 and 1.2.3.4.5 and 01.2.3.4", CARD[:-1] + str((int(CARD[-1]) + 1) % 10), "1987-13-45 and 31.02.1987",
    "000-12-3456", "in 1987, 12 of 345 or 6.789,00 and 10:20:30", "DE89370400440532013001", "v1.2.3-4", "1234567a", "a@b", "12345678901234567890123",
]


@pytest.mark.parametrize("text", FOUND)
def test_values_are_found_and_replaced_in_their_format(text):
    new, found = pii.pseudonymise(text, NAMES)
    assert [k for _, _, k, _ in found] == FOUND[text]
    for s, e, _, to in found:
        assert text[s:e] not in new
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", to))) == re.sub(
            "[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", text[s:e])))
    again, more = pii.pseudonymise(new, NAMES)
    assert [k for _, _, k, _ in more] == FOUND[text]  # what is written is valid, too
    assert again != text


@pytest.mark.parametrize("text", LEFT)
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymise(text, NAMES) == (text, [])


BESIDE = {
    "DE89 3704 0044 0532 0130 00 BIC COBADEFF": [("iban", "DE89 3704 0044 0532 0130 00")],
    "DE89370400440532013000 A": [("iban", "DE89370400440532013000")],
    "DE89370400440532013000 2 times": [("iban", "DE89370400440532013000")],
    "AB12 DE89370400440532013000 X": [("iban", "DE89370400440532013000")],
    "card 4111111111111111 12": [("card", "4111111111111111")],
    "no 12 4111111111111111": [("card", "4111111111111111")],
    "4111 1111 1111 1111 123": [("card", "4111 1111 1111 1111")],
    "call +49 3012 1234 5678 2024": [("phone", "+49 3012 1234 5678")],
}


@pytest.mark.parametrize("text", BESIDE)
def test_values_beside_other_words_and_numbers_are_found(text):
    assert [(k, text[s:e]) for s, e, k, _ in pii.replacements(text, NAMES)] == BESIDE[text]


def test_equal_values_are_linked_in_any_notation():
    def digits(text):
        return [re.sub(r"\D", "", to)[-10:] for *_, to in pii.pseudonymise(text, NAMES)[1]]

    assert len(set(digits("+1 (017) 555-7713 then 017-555-7713 then (017) 555-7713"))) == 1
    assert len(set(digits(f"{CARD} {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}"))) == 1
    days = [to for *_, to in pii.pseudonymise("1987-03-12 12.03.1987 12/03/1987", NAMES)[1]]
    y, m, d = days[0].split("-")
    assert days[1:] == [f"{d}.{m}.{y}", f"{d}/{m}/{y}"]
    assert pii.pseudonymise("x 1.2.3.4", NAMES)[1][0][3] == pii.pseudonymise("1.2.3.4, y", NAMES)[1][0][3]
    assert pii.pseudonymise("1.2.3.4", Pseudonyms(b"another"))[1][0][3] != pii.pseudonymise("1.2.3.4", NAMES)[1][0][3]


def test_documents(spark):
    rows = [(1, f"host 97.51.17.173 {CARD}"), (2, f"again {CARD}."), (2, f"again {CARD}."), (3, None), (4, ""), (None, "a 1.2.3.4"),
            (6, "1 " * 60_000 + "1.2.3.4")]
    docs = docs_table(spark, rows, "spans n_card")
    got = sorted(pii.summary(pii.replace_pii(docs, KEY)).collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 7
    for i, text in rows:
        assert by_id[i].text == (None if text is None else pii.pseudonymise(text, NAMES)[0])
    assert (by_id[1].n_ipv4, by_id[1].n_card, by_id[1].spans) == (1, 1, "ipv4:5:17,card:18:34")
    assert by_id[2].text.split()[1].rstrip(".") == by_id[1].text.split()[2]
    assert (by_id[6].n_ipv4, by_id[3].spans, by_id[4].spans) == (1, "", "")
    assert pii.replace_pii(docs.limit(0), KEY).collect() == []


def test_emails_are_found_as_by_the_plain_pattern():
    rng = random.Random(4)
    finder = pii._Emails()
    for _ in range(3000):
        text = "".join(rng.choices(["a", "b1", ".", "-", "@", " ", "co", "%", "é", "@x.org"], k=rng.randrange(1, 25)))
        want, got, at = [m.span() for m in pii._EMAIL.finditer(text)], [], 0
        while m := finder.search(text, at, len(text)):
            got.append(m.span())
            at = m.end()
        assert got == want, text


def test_a_very_long_run_beside_an_at_sign_is_passed_once():
    names = NAMES
    for text in ("x" * 1_000_000 + " @ y", "x" * 1_000_000 + "@", "@" * 300_000 + "a" * 300_000, "a" * 500_000 + "@b.c"):
        started = time.perf_counter()
        assert pii.replacements(text, names) == []
        assert time.perf_counter() - started < 1
