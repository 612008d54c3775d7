"""Pseudonyms for personal data: recognised values are checked and replaced by others of the same format.

Numbers and dates are permuted under a key within what is valid for their kind, so a value has one pseudonym in all
documents, in whatever of the known notations it is written, and different values never share one.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.llm.feistel import FIRST_DAY, LAST_DAY, Pseudonyms, iban_rest, luhn_sum, valid_ssn

KINDS = ["email", "ipv4", "date", "card", "ssn", "phone", "iban"]

# Shortest value of the patterns below.
MIN_RUN = 7
# Runs that can hold a number or date; only these are looked at more closely.
_NUMERIC = re.compile(r"[+(]?[0-9](?:[0-9 ()./:-]*[0-9])?")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_PATTERNS = [
    ("ipv4", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])")),
    ("date", re.compile(r"(?<![\w./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![\w]|[./-][0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9])")),
    ("card", re.compile(r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?![\w])")),
    ("phone", re.compile(r"(?<![\w])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){1,4}(?![\w]|[.-][0-9])")),
    ("phone", re.compile(r"(?<![\w.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w]|[.-][0-9])")),
    ("phone", re.compile(r"(?<![\w])\+[0-9]{8,15}(?![\w])")),
]


class _Emails:
    """The email pattern, looked for from each @ to both sides, so that a long run of letters is passed once."""

    LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

    def search(self, text: str, at: int, end: int) -> re.Match | None:
        mark = text.find("@", at, end)
        while mark >= 0:
            start = mark
            while start > at and text[start - 1] in self.LOCAL:
                start -= 1
            found = _EMAIL.match(text, start, end) if start < mark else None
            if found:
                return found
            at = mark + 1
            mark = text.find("@", at, end)
        return None


# Where a value of a kind can end inside a longer match that is not valid.
_MARKS = {"card": " -", "iban": " ", "phone": " "}
# Lengths of the IBANs of each country.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}


def _tries(kind: str, pattern: re.Pattern | _Emails, m: re.Match) -> Iterator[re.Match]:
    """A match and the shorter ones from the same start, the likeliest first."""
    text, start = m.string, m.start()
    ends = [i for i in range(m.end() - 1, start, -1) if text[i] in _MARKS.get(kind, "") and text[i - 1] not in " -"]
    length = _IBAN_LENGTHS.get(m[0][:2]) if kind == "iban" else None
    if length:
        # The country says where the value ends; the whole match comes after it.
        exact = [i for i in ends if i - start - text.count(" ", start, i) == length]
        yield from filter(None, (pattern.fullmatch(text, start, i) for i in exact))
        ends = []
    yield m
    yield from filter(None, (pattern.fullmatch(text, start, i) for i in ends))


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _date(m: re.Match, names: Pseudonyms) -> str | None:
    first = m[1] is not None
    year, mark = (m[1], m[2]) if first else (m[8], m[6])
    a, b = (m[3], m[4]) if first else (m[5], m[7])
    # Year first means month before day; else the day stands first, unless only the other reading is a date.
    for month, day, swapped in ((a, b, False),) if first else ((b, a, False), (a, b, True)):
        try:
            found = dt.date(int(year), int(month), int(day))
        except ValueError:
            continue
        if not FIRST_DAY <= found <= LAST_DAY:
            return None
        new = names.date(found)
        wide = max(len(a), len(b)) == 2 and min(len(a), len(b)) == 2
        parts = [f"{x:02d}" if wide else str(x) for x in (new.month, new.day)]
        if first:
            return mark.join([f"{new.year:04d}", *parts])
        return mark.join([*(parts if swapped else reversed(parts)), f"{new.year:04d}"])
    return None


def _ipv4(m: re.Match, names: Pseudonyms) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    return ".".join(map(str, names.ipv4([int(p) for p in parts])))


def _card(m: re.Match, names: Pseudonyms) -> str | None:
    digits = _digits(m[0])
    return _refill(m[0], names.card(digits)) if luhn_sum(digits) == 0 and set(digits) != {"0"} else None


def _ssn(m: re.Match, names: Pseudonyms) -> str | None:
    digits = _digits(m[0])
    return _refill(m[0], names.ssn(digits)) if valid_ssn(digits) else None


def _phone(m: re.Match, names: Pseudonyms) -> str | None:
    """The country code, if there is one, stays; the number after it is permuted."""
    text = m[0]
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = code[0] if code else ""
    digits = _digits(text[len(head) :])
    if not 7 <= len(digits) <= 15 - max(len(head) - 1, 0):
        return None
    return head + _refill(text[len(head) :], names.digits("phone", digits))


def _email(m: re.Match, names: Pseudonyms) -> str | None:
    local, _, domain = m[0].partition("@")
    return f"{names.name('email ' + domain.lower(), local)}@{domain}"


def _iban(m: re.Match, names: Pseudonyms) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    new = iter(names.iban(plain))
    return "".join(c if c == " " else next(new) for c in m[0])


_CHANGES: dict[str, Callable[[re.Match, Pseudonyms], str | None]] = {
    "email": _email, "ipv4": _ipv4, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone, "iban": _iban,
}


def replacements(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all values, left to right without overlaps.

    Emails are taken first, then IBANs, then the patterns in the order listed; what one has taken, none takes again.
    """
    found: list[tuple[int, int, str, str]] = []

    def take(kind: str, pattern: re.Pattern | _Emails, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Parts are (start, end, how far the pattern may look); returns what is left of them."""
        left = []
        for start, end, sight in parts:
            at = start
            while whole := pattern.search(text, at, sight):
                # Where no end gives a valid value, a later start inside the match may.
                at = whole.start() + 1 if kind in _MARKS else whole.end()
                for m in _tries(kind, pattern, whole):
                    new = _CHANGES[kind](m, names) if m.end() <= end else None
                    if new is not None:
                        found.append((*m.span(), kind, new))
                        left.append((start, m.start(), m.start()))
                        start = at = m.end()
                        break
            left.append((start, end, sight))
        return left

    parts = [(0, len(text), len(text))]
    if "@" in text:
        parts = take("email", _Emails(), parts)
    parts = take("iban", _IBAN, parts)
    for start, end, sight in parts:
        for run in _NUMERIC.finditer(text, start, end):
            inside = [(*run.span(), min(run.end() + 2, sight))]
            for kind, pattern in _PATTERNS if len(run[0]) >= MIN_RUN else []:
                inside = take(kind, pattern, inside)
    return sorted(found)


def pseudonymise(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with all values replaced, and the replacements."""
    found, out, at = replacements(text, names), [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(0).to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, names)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k, _ in found])
            columns = [pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN))]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *rest], ["text", "spans", *batch.schema.names[1:]])

    return run


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, spans, id): every document's text with pseudonyms, and (kind, start, end) of what was replaced in it.

    Spans are code points of the original text, end exclusive. Null texts stay null, empty ones empty; texts without a
    valid value stay as they are. Repeated rows are handled each; other columns are ignored; an empty table gives an
    empty one. The permutations are those of ``key``: whoever has it can undo them, nobody else.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text).alias("_text"), id_col).mapInArrow(
        _replace(key), f"text string, spans array<struct<kind: string, start: bigint, end: bigint>>, `{id_col}` {kind}"
    )


def summary(replaced: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, n_<kind>, spans): counts per kind, and all spans in one string."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return replaced.select(id_col, "text", *(count(k) for k in KINDS), F.array_join(spans, ",").alias("spans"))
