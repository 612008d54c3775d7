"""Secrets in texts: three fixed patterns, and a conditional random field for secrets that no pattern names.

The field reads every line of every text. A line is cut into alphanumeric runs and single marks, each described by its
shape, its neighbours and the file it stands in, and Viterbi decoding tags them. Tokens that are outside on the best path
whatever stands beside them are told by their scores alone, so paths are only followed between them; the tags are those of
the whole line. The field is trained on the patterns' own hits, on windows around other runs of key characters, and on
pieces of lines without such runs; in half of the windows the neighbours are hidden, so that shape alone has to carry a
key, too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.llm import crf
from askahead.llm.common import stored
from askahead.llm.crf import BEGIN, BUCKETS, INSIDE, OUTSIDE, TAGS, Crf, bucket
from askahead.operators.sampling import at_most

KINDS = ["assign", "access", "hex", "field"]
# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_RUN, BEFORE, AFTER = 12, 40, 24
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_PIECE = re.compile(_TOKEN.pattern + r"|\s+")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
MAX_WINDOWS = 2000
_NEAR = (-3, -2, -1, 1, 2)
_NEAR_CRC = [zlib.crc32(f"{d} ".encode()) for d in _NEAR]
# What a task remembers of tokens that it has seen.
_SEEN_TOKENS, _SEEN_CHARS = 1 << 17, 1 << 24

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' hits, each kind leftmost and without overlaps, by start, then kind."""
    found: list[Span] = []
    folded = text.encode("utf-8", "replace").lower()
    if any(name in folded for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # A run of hexadecimal digits is found whole or, if it is too short, not at all.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(found)


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of lines to train on: around every run of at least ``MIN_RUN`` key characters with a digit among them.

    Overlapping parts are one.
    """
    found: list[tuple[int, int]] = []
    run_end = -1
    for digits in _DIGITS.finditer(text):
        at = digits.start()
        if at < run_end:
            continue
        lo = at
        while lo > 0 and text[lo - 1] in _KEY_CHARS:
            lo -= 1
        hi = run_end = _RUN.match(text, at).end()
        if hi - lo < MIN_RUN:
            continue
        start = max(text.rfind("\n", max(lo - BEFORE, 0), lo) + 1, lo - BEFORE, 0)
        stop = text.find("\n", hi, hi + AFTER)
        stop = min(hi + AFTER, len(text)) if stop < 0 else stop
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], stop)
        else:
            found.append((start, stop))
    return found


def _shape(token: str) -> list[str]:
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper, lower = sum("A" <= c <= "Z" for c in token), sum("a" <= c <= "z" for c in token)
    size = "1" if n == 1 else "2-7" if n < 8 else "8-11" if n < 12 else "12-15" if n < 16 else "16-23" if n < 24 else "24+"
    cases = ("U" if upper else "") + ("l" if lower else "") + ("d" if digits else "")
    hexa = all(c in "0123456789abcdef" for c in token)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return [
        f"size {size}",
        f"cases {cases} {size}",
        f"hex {hexa} {size}",
        f"mix {min(changes, 6)} {size}",
        f"share {4 * digits // n} {size}",
        f"mark {token}" if n == 1 and not token.isalnum() else "word",
    ]


def _beside(token: str, shape: list[str]) -> str:
    """What a token is to its neighbours."""
    near = token.lower()
    return near if len(near) < 12 else shape[1]


def features(text: str, start: int, end: int, file: list[str], hidden: bool = False):
    """(spans, feature buckets, joined flags) of the tokens of a window; ``hidden`` leaves the neighbours out."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    tokens = [text[a:b] for a, b in spans]
    shapes = [_shape(t) for t in tokens]
    rows, joined = [], []
    for i, own in enumerate(shapes):
        joined.append(i > 0 and spans[i - 1][1] == spans[i][0])
        names = ["bias", *own, *file, f"joined {joined[-1]} {own[0]}"]
        if not hidden:
            for d in _NEAR:
                names.append(f"{d} {_beside(tokens[i + d], shapes[i + d]) if 0 <= i + d < len(tokens) else 'edge'}")
        rows.append([bucket(n) for n in names])
    return spans, rows, joined


def file_features(text: str) -> list[str]:
    """What a text as a whole says about the chance of secrets in it."""
    n = max(len(text), 1)
    return [f"equals {min(text.count('=') * 200 // n, 3)}", f"lines {min(text.count(chr(10)) * 40 // n, 3)}"]


class Tagger(dict):
    """Tags of whole texts; remembers the scores of tokens, which are the keys, by the row of ``table`` they stand in.

    Rows 0 and 1 stand for spaces without and with a line end; row 0 adds to its neighbours what an edge does.
    """

    def __init__(self, field: Crf) -> None:
        super().__init__()
        self.field, self.steps = field, field.steps.tolist()
        # Per token: scores if not joined to the one before, if joined, and what it adds to its neighbours.
        self.table = np.zeros((1024, 2 + len(_NEAR), TAGS))
        self.table[0, 2:] = [field.weights[bucket(f"{d} edge")] for d in _NEAR]
        self.n_rows, self.n_chars = 2, 0
        # Of tokens not in the table yet: the number of what their shape scores, and the CRCs of their names as neighbours.
        self.new_own: list[int] = []
        self.new_near: list[int] = []
        self.own = np.zeros((0, 2, TAGS))
        self.shapes: dict[tuple, tuple[int, str]] = {}
        # The least that steps can gain where a token becomes outside: from before it, to after it, and one further on,
        # where an inside token after it has to begin.
        s, allowed = field.steps, [(p, x) for p in range(TAGS) for x in (BEGIN, INSIDE) if (p, x) != (OUTSIDE, INSIDE)]
        self.gain = min(0.0, *(s[p, OUTSIDE] - s[p, x] for p, x in allowed)) + min(
            0.0, *(s[OUTSIDE, BEGIN if z == INSIDE else z] - s[x, z] for x in (BEGIN, INSIDE) for z in range(TAGS))
        )
        self.gain_next = min(0.0, *(s[BEGIN, z] - s[INSIDE, z] for z in range(TAGS)))

    def __missing__(self, token: str) -> int:
        self.n_chars += len(token)
        if token.isspace():
            self[token] = row = int("\n" in token)
            return row
        row, (own, beside) = self.n_rows, self._own(token)
        near = (token.lower() if len(token) < 12 else beside).encode()
        self.new_own.append(own)
        # The CRC of "distance token" goes on from that of "distance ".
        self.new_near += [zlib.crc32(near, c) for c in _NEAR_CRC]
        self.n_rows += 1
        self[token] = row
        return row

    def scored(self) -> np.ndarray:
        """The table with the scores of all tokens seen."""
        if self.new_own:
            while self.n_rows > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            new = slice(self.n_rows - len(self.new_own), self.n_rows)
            self.table[new, :2] = self.own[self.new_own]
            near = 1 + np.array(self.new_near, np.int64).reshape(-1, len(_NEAR)) % (BUCKETS - 1)
            self.table[new, 2:] = self.field.weights[near]
            self.new_own, self.new_near = [], []
        return self.table

    def _own(self, token: str) -> tuple[int, str]:
        """The number in ``own`` of what a token's shape scores, and its name to the neighbours of a long one."""
        # The shape of ASCII letters follows from this much of them, that of others is taken whole.
        letters = token.isascii() and token.isalpha()
        key = (min(len(token), 24), token.isupper(), token.islower(), not token.strip("abcdef")) if letters else None
        found = self.shapes.get(key)
        if found is None:
            shape = _shape(token)
            key = key or tuple(shape)
            found = self.shapes.get(key)
            if found is None:
                names = [["bias", *shape, f"joined {joined} {shape[0]}"] for joined in (False, True)]
                scores = [self.field.weights[[bucket(n) for n in row]].sum(axis=0) for row in names]
                self.own = np.concatenate([self.own, [scores]])
                found = self.shapes[key] = len(self.own) - 1, shape[1]
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of what the best path of each line tags."""
        if self.n_rows > _SEEN_TOKENS or self.n_chars > _SEEN_CHARS:
            self.clear()
            self.new_own, self.new_near = [], []
            self.n_rows, self.n_chars = 2, 0
        pieces = _PIECE.findall(text)
        rows = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        real = rows > 1
        n = int(real.sum())
        if not n:
            return []
        line, end, tokens = np.cumsum(rows == 1)[real], ends[real], rows[real]
        start = end - lengths[real]
        joined = np.zeros(n + 1, bool)
        joined[1:n] = start[1:] == end[:-1]
        width = 2 + len(_NEAR)
        table = self.scored().reshape(-1, TAGS)
        at = tokens * width
        score = table.take(at + joined[:n], axis=0)
        score += self.field.weights[[bucket(f) for f in file_features(text)]].sum(axis=0)
        for k, d in enumerate(_NEAR, 2):
            beside = np.full(n, k)
            if abs(d) < n:
                here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
                beside[here] += at[there] * (line[here] == line[there])
            score += table.take(beside, axis=0)
        inside = np.where(joined[:n], score[:, INSIDE], -np.inf)
        change = np.zeros(n)
        change[:-1] = np.where(joined[1:n], score[1:, BEGIN] - score[1:, INSIDE], 0.0)
        certain = score[:, OUTSIDE] - np.maximum(score[:, BEGIN], inside)
        certain += self.gain + np.where(joined[1:], np.minimum(0.0, change + self.gain_next), 0.0)
        open_at = np.flatnonzero(certain <= 1e-9)
        found = []
        if len(open_at):
            apart = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(line[open_at]) > 0)) + 1
            firsts, lasts = open_at[np.r_[0, apart]].tolist(), open_at[np.r_[apart - 1, len(open_at) - 1]].tolist()
            for a, b in zip(firsts, lasts, strict=True):
                after = a > 0 and line[a - 1] == line[a]
                before = b + 1 < n and line[b + 1] == line[b]
                tags = self._path(score[a : b + 1].tolist(), joined[a : b + 1].tolist(), after, before)
                for i, tag in enumerate(tags, a):
                    if tag == BEGIN:
                        found.append((int(start[i]), int(end[i])))
                    elif tag == INSIDE:
                        found[-1] = (found[-1][0], int(end[i]))
        return found

    def _path(self, score: list[list[float]], joined: list[bool], after: bool, before: bool) -> list[int]:
        """Best tags of a stretch; an outside token stands before it if ``after``, and behind it if ``before``."""
        s, never = self.steps, float("-inf")
        entry = s[OUTSIDE] if after else (0.0, 0.0, 0.0)
        best = [score[0][OUTSIDE] + entry[OUTSIDE], score[0][BEGIN] + entry[BEGIN], never]
        back = []
        for row, bound in zip(score[1:], joined[1:], strict=True):
            out, pointers = [], []
            for tag in range(TAGS):
                top, origin = never, BEGIN
                if tag != INSIDE or bound:
                    for p in (BEGIN, INSIDE) if tag == INSIDE else (OUTSIDE, BEGIN, INSIDE):
                        if best[p] + s[p][tag] > top:
                            top, origin = best[p] + s[p][tag], p
                out.append(top + row[tag])
                pointers.append(origin)
            best = out
            back.append(pointers)
        if before:
            best = [v + s[p][OUTSIDE] for p, v in enumerate(best)]
        tags = [best.index(max(best))]
        for pointers in reversed(back):
            tags.append(pointers[tags[-1]])
        return tags[::-1]


def field_spans(text: str, field: Crf | Tagger, base: list[Span]) -> list[Span]:
    """Spans that the field tags anywhere in the text and no base span overlaps."""
    tagger = field if isinstance(field, Tagger) else Tagger(field)
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max, initial=-1))
    # Of the base spans that start before a span ends, none may end after its start.
    return [(start, 3, end) for start, end in tagger.spans(text) if reach[bisect_left(starts, end)] <= start]


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _plain_piece(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One piece of a line, at a place that a hash of the text draws, if it is apart from ``parts``."""
    place = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()) % max(len(text), 1)
    start = max(text.rfind("\n", 0, place) + 1, place - BEFORE)
    stop = text.find("\n", start, place + AFTER)
    stop = min(place + AFTER, len(text)) if stop < 0 else stop
    piece = (start, stop)
    return [piece] if text[start:stop].strip() and all(stop <= a or b <= start for a, b in parts) else []


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window with its tags by the base spans; the value of an assignment is its secret part."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            text = text or ""
            runs = windows(text)
            parts = runs + _plain_piece(text, runs)
            if not parts:
                continue
            base, file = base_spans(text), file_features(text)
            secret = [(ASSIGN.match(text, s).start(2) if kind == 0 else s, e) for s, kind, e in base]
            for n, (start, end) in enumerate(parts):
                part = text[start:end]
                key = hashlib.blake2b(part.encode("utf-8", "replace"), digest_size=16).hexdigest()
                tags, before = [], None
                for m in _TOKEN.finditer(text, start, end):
                    owner = next((s for s in secret if s[0] <= m.start() and m.end() <= s[1]), None)
                    tags.append(OUTSIDE if owner is None else INSIDE if owner == before else BEGIN)
                    before = owner
                out.append({"key": key, "part": part, "file": file, "tags": tags, "kind": 0 if any(tags) else 1 if n < len(runs) else 2})
        yield pa.RecordBatch.from_pylist(out, _TRAIN)


_TRAIN = pa.schema(
    [("key", pa.string()), ("part", pa.string()), ("file", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())),
     ("kind", pa.int32())]
)


def train(docs: DataFrame, text: str = "text", max_windows: int = MAX_WINDOWS) -> Crf:
    """A field fitted on at most ``max_windows`` different windows, half of them with base secrets where there are so many.

    A quarter are other runs of key characters, and a quarter are pieces without any, of which a text gives one at most.
    Which windows are drawn depends on a hash of their text. A corpus without any window gives a field that finds
    nothing.
    """
    fields = "key string, part string, file array<string>, tags array<int>, kind int"
    found = docs.select(text).mapInArrow(_training_rows, fields)
    # Of a window's copies the one with the smallest columns, so that the draw is the same on every run.
    rest = F.struct("kind", "tags", "file", "part")
    parts = stored(found.groupBy("key").agg(F.min(rest).alias("w")).select("key", "w.*"), "windows")
    drawn = []
    for kind, share in enumerate((2, 4, 4)):
        rows = at_most(parts.where(F.col("kind") == kind), F.col("key"), max_windows // share).collect()
        for r in sorted(rows, key=lambda r: r["key"]):
            _, names, _ = features(r["part"], 0, len(r["part"]), r["file"], hidden=int(r["key"][-1], 16) % 2 == 0)
            drawn.append((names, r["tags"]))
    return crf.fit(drawn)


def _scan(field: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                base = base_spans(text)
                out.append(sorted(base + field_spans(text, tagger, base)))
            spans = pa.array(
                [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in out],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
            )
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([spans, *rest], ["spans", *batch.schema.names[1:]])

    return run


def scan(docs: DataFrame, field: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): per document all spans (kind, start, end) in code points, end exclusive, by start, then kind.

    Kinds are ``assign``, ``access`` and ``hex`` for the patterns and ``field`` for what only the field finds, which
    never overlaps the others. Null and empty texts have none. Repeated rows are scanned each; other columns are ignored;
    an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text).alias("_text"), id_col).mapInArrow(
        _scan(field), f"spans array<struct<kind: string, start: bigint, end: bigint>>, `{id_col}` {kind}"
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans in one string."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return scanned.select(
        id_col,
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
