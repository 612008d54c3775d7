"""Quality scores of documents by boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.functions import draw_key
from askahead.llm.boosting import Forest, train
from askahead.llm.common import text_bytes
from askahead.operators.sampling import at_most

THRESHOLD = 0.7
# Labelled documents the trees are fitted on at most.
MAX_TRAIN = 20_000

_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "quote", "bracket", "bar", "bang", "sign", "other", "high"]


def _byte_class(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        name = "high"
    elif c.isupper():
        name = "upper"
    elif c.islower():
        name = "lower"
    elif c.isdigit():
        name = "digit"
    elif c == "\n":
        name = "newline"
    elif c.isspace():
        name = "space"
    else:
        marks = {"stop": ".,;:", "quote": "'\"`", "bracket": "()[]{}<>", "bar": "|", "bang": "!?", "sign": "#$%&*@^~+=/\\_-"}
        name = next((k for k, v in marks.items() if c in v), "other")
    return _CLASSES.index(name)


_CLASS_OF = bytes(_byte_class(b) for b in range(256))
_WORD_STATS = 12
WIDTH = len(_CLASSES) + _WORD_STATS


def statistics(text: bytes | None) -> list[float]:
    """Shares of byte classes, sizes, and how words and lines repeat; null counts as empty."""
    text = text or b""
    n = max(len(text), 1)
    shares = np.bincount(np.frombuffer(text.translate(_CLASS_OF), np.uint8), minlength=len(_CLASSES)) / n
    words, lines = text.split(), text.split(b"\n")
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    common = sum(c for _, c in counts.most_common(3))
    return [
        *shares.tolist(),
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / m,
        common / m,
        sum(map(eq, words, words[1:])) / m,
        sum(map(eq, words, words[2:])) / m,
        sum(w.endswith((b".", b",")) for w in words) / m,
        sum(w[:1].isupper() for w in words) / m,
        len(words) / len(lines),
        1 - len(set(lines)) / len(lines),
    ]


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(-1, WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = pa.array(_rows(batch.column(0)).tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([stats, batch.column(1)], ["stats", "label"])


def _scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array(forest.score(_rows(batch.column(0))), pa.float64())
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([column, *rest], ["score", *batch.schema.names[1:]])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_train: int = MAX_TRAIN,
) -> Forest:
    """Trees fitted on at most ``max_train`` labelled documents, drawn by a hash of their ids, never held-out ones.

    Null labels and labels without a document are passed over; a document with several labels is used with the highest.
    Without any label, the forest has no trees and every score is one, so that nothing is rejected unseen.
    """
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_labelled"))
        .agg(F.max(label).cast("int").alias("_label"))
    )
    drawn = at_most(drawn, draw_key(0, "_labelled"), max_train)
    # The draw has at most max_train rows of two numbers.
    sample = (
        docs.select(F.col(id_col).alias("_doc"), text_bytes(text).alias("_text"))
        .join(F.broadcast(drawn), F.col("_doc") == F.col("_labelled"))
        .select("_text", "_label")
        .mapInArrow(_features, "stats array<double>, label int")
        .orderBy(F.xxhash64("stats"), "stats", "label")  # bounds the rows also where ids repeat
        .limit(max_train)
        .toArrow()
    )
    if not sample.num_rows:
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), np.inf)
    rows = np.array(sample.column("stats").to_pylist(), np.float64)
    return train(rows, np.array(sample.column("label").to_pylist(), np.float64))


def score(docs: DataFrame, forest: Forest, carry: list[str], text: str = "text") -> DataFrame:
    """(score, carried columns): the probability of label 1 for the whole text, empty and null texts too."""
    fields = ", ".join(["score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    return docs.select(text_bytes(text).alias("_text"), *carry).mapInArrow(_scores(forest), fields)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) per document; repeated rows each get theirs, null ids are not held out.

    Only the text enters a score. Other columns are ignored; an empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels, id_col, text, **options), [id_col], text)
    return scored.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose score reaches the threshold, in one pass over the table."""
    forest = fit(docs, labels, id_col, text, **options)
    # Prefixed, so that a column of docs may be called score.
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index(text)
    scored = score(plain, forest, plain.columns, f"_c{at}").where(F.col("score") >= THRESHOLD)
    return scored.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
