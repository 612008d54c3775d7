"""Keyed permutations of small domains by a Feistel network, and of values within their format."""

from __future__ import annotations

import datetime as dt
import hashlib
from math import isqrt

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. size-1 without fixed points.

    The network works on pairs of digits in base ceil(sqrt(size)); results outside the domain are permuted again until
    one lies inside, which keeps it a permutation. Between the network and its inverse stands a keyed rotation, so no
    value can stay what it is.
    """

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.base = isqrt(max(size - 1, 0)) + 1
        self.key = hashlib.blake2b(f"{tweak}\x00{size}".encode(), key=key[:64], digest_size=32).digest()
        self.turn = 1 + self._noise(ROUNDS, 0) % (size - 1) if size > 1 else 0

    def _noise(self, round_no: int, value: int) -> int:
        data = round_no.to_bytes(1, "big") + value.to_bytes(16, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def _forward(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.base)
            for i in range(ROUNDS):
                a, b = b, (a + self._noise(i, b)) % self.base
            value = a * self.base + b
            if value < self.size:
                return value

    def _backward(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.base)
            for i in range(ROUNDS - 1, -1, -1):
                a, b = (b - self._noise(i, a)) % self.base, a
            value = a * self.base + b
            if value < self.size:
                return value

    def encrypt(self, value: int) -> int:
        return self._backward((self._forward(value) + self.turn) % self.size)

    def decrypt(self, value: int) -> int:
        return self._backward((self._forward(value) - self.turn) % self.size)


class Pseudonyms:
    """Pseudonyms of values by kind: the same value always gets the same one, valid values get valid ones."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key = key
        self.known: dict[tuple[str, int], Permutation] = {}

    def _of(self, kind: str, size: int) -> Permutation:
        if (kind, size) not in self.known:
            self.known[kind, size] = Permutation(self.key, kind, size)
        return self.known[kind, size]

    def number(self, kind: str, value: int, size: int, back: bool = False) -> int:
        of = self._of(kind, size)
        return of.decrypt(value) if back else of.encrypt(value)

    def digits(self, kind: str, digits: str, back: bool = False) -> str:
        """Another digit string of the same length."""
        return str(self.number(kind, int(digits), 10 ** len(digits), back)).zfill(len(digits))

    def card(self, digits: str, back: bool = False) -> str:
        """Another number with a right Luhn digit."""
        body = self.digits("card", digits[:-1], back)
        return body + str(-luhn_sum(body + "0") % 10)

    def ssn(self, digits: str, back: bool = False) -> str:
        """Another nine digits that pass the same rules; those that do not are passed on until one does."""
        while True:
            digits = self.digits("ssn", digits, back)
            if valid_ssn(digits):
                return digits

    def date(self, day: dt.date, back: bool = False) -> dt.date:
        """Another day of the years that are recognised."""
        n = self.number("date", day.toordinal() - FIRST_DAY.toordinal(), LAST_DAY.toordinal() - FIRST_DAY.toordinal() + 1, back)
        return dt.date.fromordinal(FIRST_DAY.toordinal() + n)

    def ipv4(self, octets: list[int], back: bool = False) -> list[int]:
        n = self.number("ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32, back)
        return list(n.to_bytes(4, "big"))

    def iban(self, text: str, back: bool = False) -> str:
        """Country, length and letters stay; digits change and the check digits follow."""
        digits = "".join(c for c in text[4:] if c.isdigit())
        new = iter(self.digits("iban " + text[:2], digits, back)) if digits else iter("")
        body = "".join(next(new) if c.isdigit() else c for c in text[4:])
        return f"{text[:2]}{98 - iban_rest(text[:2] + '00' + body):02d}{body}"

    def name(self, kind: str, text: str, back: bool = False) -> str:
        """ASCII letters become letters of the same case and digits digits, all other characters stay."""
        low = text.lower()
        radices = [10 if c.isdigit() else 26 for c in low if c.isascii() and c.isalnum()]
        value, size = 0, 1
        for c, r in zip((c for c in low if c.isascii() and c.isalnum()), radices, strict=True):
            value, size = value * r + (int(c) if r == 10 else ord(c) - 97), size * r
        if size == 1:
            return text
        value = self.number(f"{kind} {radices}", value, size, back)
        out = []
        for r in reversed(radices):
            value, x = divmod(value, r)
            out.append(str(x) if r == 10 else chr(97 + x))
        new = iter(reversed(out))
        swapped = (next(new) if c.isascii() and c.isalnum() else c for c in text)
        return "".join(x.upper() if c.isupper() and x.isascii() else x for c, x in zip(text, swapped, strict=True))


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def luhn_sum(digits: str) -> int:
    """Zero modulo 10 for a right number."""
    doubled = (sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10


def valid_ssn(digits: str) -> bool:
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def iban_rest(text: str) -> int:
    """The number modulo 97 of an IBAN, 1 for a right one."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97
