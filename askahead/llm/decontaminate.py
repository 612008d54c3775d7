"""Benchmark decontamination by winnowed fingerprints.

Texts are cut into words; a passage of ``span`` words shared by a document and a benchmark item is a hit. Of the hashes
of all k-grams, the smallest of every window of ``span - k + 1`` is kept (the rightmost of equal ones), so two texts that
share ``span`` words share a kept hash inside them. Kept hashes are joined and extended word by word, which also rules
out chance hits. Items with fewer than ``span`` words are searched by the hash of all their words.

Only document hashes whose bit is set in a bitmap of the benchmark's hashes leave the scan. The bitmap has a fixed size;
a larger benchmark sets more bits and lets more through, the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import stored, text_bytes, with_row_id

SPAN = 10
BITMAP_BITS = 23
_WORD_CACHE = 300_000
_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# Word bytes are 0-9, A-Z as a-z, a-z and all of non-ASCII characters; the rest separates words.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    return (text or b"").translate(_FOLD).split()


class _WordHashes(dict):
    """Hash of each word seen, forgotten together when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One mixed hash per k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    grams = np.full(n, k, np.uint64)
    for j in range(k):
        grams = grams * _P + hashes[j : j + n]
    grams = (grams ^ (grams >> np.uint64(32))) * _C
    return grams ^ (grams >> np.uint64(29))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    smallest = grams[:n].copy()
    for j in range(1, window):
        np.minimum(smallest, grams[j : j + n], out=smallest)
    kept, settled = np.zeros(len(grams), bool), np.zeros(n, bool)
    for j in range(window - 1, -1, -1):
        here = (grams[j : j + n] == smallest) & ~settled
        kept[j : j + n] |= here
        settled |= here
    return np.flatnonzero(kept)


class Extractor:
    """Fingerprints with the words around them: (hash, position, size, words).

    ``size`` is the span for winnowed k-grams, whose words reach ``span - k`` to either side (null beyond the text's
    ends), and the number of words for the hash of a short passage.
    """

    def __init__(self, span: int) -> None:
        self.span, self.k = span, max(1, span // 2)
        self.reach = span - self.k
        self.hashes = _WordHashes()

    def hash_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def around(self, words: list[str], at: int) -> list[str | None]:
        lo, hi = at - self.reach, at + self.k + self.reach
        return [None] * -min(lo, 0) + words[max(lo, 0) : hi] + [None] * max(hi - len(words), 0)

    def of_item(self, words: list[bytes]) -> list[tuple[int, int, int, list]]:
        hashes, text = self.hash_words(words), [w.decode("utf-8", "replace") for w in words]
        if len(words) < self.span:
            return [(int(h), 0, len(words), text) for h in _gram_hashes(hashes, len(words))] if words else []
        grams = _gram_hashes(hashes, self.k)
        return [(int(grams[p]), int(p), self.span, self.around(text, p)) for p in winnow(grams, self.reach + 1)]

    def of_document(self, words: list[bytes], short: list[int], bitmap: np.ndarray) -> list[tuple[int, int, int, list]]:
        """Fingerprints whose bit is set, of short passages for each of the lengths in ``short``."""
        hashes, found, text = self.hash_words(words), [], None
        for size in [self.span, *short]:
            grams = _gram_hashes(hashes, self.k if size == self.span else size)
            place = grams >> np.uint64(64 - BITMAP_BITS)
            known = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            if not known.any():
                continue
            if size == self.span:
                kept = winnow(grams, self.reach + 1)
                at = kept[known[kept]]
            else:
                at = np.flatnonzero(known)
            if text is None and at.size:
                text = [w.decode("utf-8", "replace") for w in words]
            for p in at.tolist():
                near = self.around(text, p) if size == self.span else text[p : p + size]
                found.append((int(grams[p]), p, size, near))
        return found


_HIT = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("near", pa.list_(pa.string()))])
_HIT_DDL = "struct<hash: bigint, pos: int, size: int, near: array<string>>"


def _records(hits: list[tuple[int, int, int, list]]) -> list[dict]:
    return [{"hash": h - (1 << 64) if h >> 63 else h, "pos": p, "size": s, "near": n} for h, p, s, n in hits]


def _item_prints(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(span)
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            norm = [b" ".join(w).decode("utf-8", "replace") for w in words]
            hits = [_records(extractor.of_item(w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm, pa.string()), pa.array(hits, pa.list_(_HIT))], ["item", "norm", "hits"]
            )

    return run


def _document_prints(span: int, short: list[int], bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(span)
        for batch in batches:
            counts, hits = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                hits.append(_records(extractor.of_document(words, short, bitmap)))
            columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT))]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *rest], ["n_words", "hits", *batch.schema.names[1:]])

    return run


def hash_bitmap(prints: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the hashes in a table, such as the benchmark's, combined on the executors."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = (
        prints.select(F.shiftright(place, 6).alias("at"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .select("at", F.expr("shiftleft(1L, bit)").alias("mask"))
        .groupBy("at")
        .agg(F.bit_or("mask").alias("mask"))
        .collect()  # at most 2 ** (BITMAP_BITS - 6) rows, whatever the table's size
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in rows:
        bitmap[row["at"]] = row["mask"]
    return bitmap.view(np.uint64)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, carried columns), one row per document.

    ``n_hit`` counts the words inside any occurrence of a window of ``span`` item words (all words of a shorter item),
    ``spans`` lists the occurrences' (start, end) in words, merged where they overlap. ``items_sha256`` is taken over
    the ids of items with hits, sorted as strings and joined by commas. Null and empty texts have no words; items
    without words occur nowhere. Repeated item ids count once, items with null id mark words but are not counted.
    Repeated documents each get their row. Other columns are ignored; empty tables give empty or clean results.
    """
    carry = [c for c in carry or [] if c != id_col]
    kind = benchmark.schema[item_col].dataType.simpleString()
    items = stored(
        benchmark.select(F.col(item_col).alias("item"), text_bytes(item_text).alias("text")).mapInArrow(
            _item_prints(span), f"item {kind}, norm string, hits array<{_HIT_DDL}>"
        ),
        "item_prints",
    )
    # Items with the same words are one class, so that copies among them multiply nothing.
    members = items.select(F.sha2("norm", 256).alias("class"), F.col("item").cast("string").alias("item")).distinct()
    prints = stored(
        items.select(F.sha2("norm", 256).alias("class"), F.explode("hits").alias("h"))
        .select("class", "h.hash", "h.size", F.col("h.near").alias("item_near"))
        .distinct(),
        "benchmark_prints",
    )
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # at most ``span`` of them
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *carry])
    scanned = stored(
        docs.select(text_bytes(text).alias("_text"), id_col, *carry)
        .mapInArrow(
            _document_prints(span, sorted(set(sizes) - {span}), hash_bitmap(prints)),
            f"n_words bigint, hits array<{_HIT_DDL}>, {fields}",
        )
        .withColumn("_row", F.monotonically_increasing_id()),
        "document_prints",
    )
    k, reach = max(1, span // 2), span - max(1, span // 2)

    def same(i: int) -> F.Column:
        return F.coalesce(F.get("near", F.lit(i)) == F.get("item_near", F.lit(i)), F.lit(False))

    def run_length(positions: list[int]) -> F.Column:
        out = F.lit(len(positions))
        for n, i in reversed(list(enumerate(positions))):
            out = F.when(~same(i), F.lit(n)).otherwise(out)
        return out

    left = run_length(list(range(reach - 1, -1, -1)))
    right = run_length(list(range(reach + k, reach + k + reach)))
    core = same(reach)
    for i in range(reach + 1, reach + k):
        core = core & same(i)
    long = F.col("size") == span
    found = (
        scanned.select("_row", F.explode("hits").alias("h"))
        .select("_row", "h.*")
        .join(prints, ["hash", "size"])
        .where(F.when(long, core).otherwise(F.col("near") == F.col("item_near")))
        .withColumn("_l", F.when(long, left).otherwise(F.lit(0)))
        .withColumn("_r", F.when(long, right).otherwise(F.lit(0)))
        .withColumn("_start", F.col("pos") - F.col("_l"))
        .withColumn("_end", F.col("pos") + F.when(long, F.lit(k) + F.col("_r")).otherwise(F.col("size")))
        .where(F.col("_end") - F.col("_start") >= F.col("size"))
        .select("_row", "class", "_start", "_end")
    )
    found = stored(found, "passages")
    merged = F.aggregate(
        "all",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    spans = (
        found.groupBy("_row")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("all"))
        .select("_row", merged.alias("spans"))
    )
    hit_items = (
        found.select("_row", "class")
        .distinct()
        .join(members, "class")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set("item")).alias("_items"))
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    none = F.array().cast("array<string>")
    return (
        scanned.drop("hits")
        .join(spans, "_row", "left")
        .join(hit_items, "_row", "left")
        .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
        .withColumn("_items", F.coalesce("_items", none))
        .select(
            id_col,
            "n_words",
            n_hit.alias("n_hit"),
            F.size("_items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            "spans",
            *carry,
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows in which no benchmark passage occurs."""
    numbered, rid = with_row_id(docs)
    hit = decontaminate(numbered, benchmark, [rid], **options).where("contaminated").select(rid)
    return numbered.join(stored(hit, "contaminated"), rid, "left_anti").select(docs.columns)
