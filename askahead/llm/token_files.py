"""Token ids of a corpus in ascending document order, as one wavelet-matrix file per shard.

A shard file is: magic, the number of documents and of bytes of its index, the compressed index (document ids, null
flags, starts within the shard), then the wavelet matrix. Tasks write under names of their own and report them; only
reported files are read, so a repeated task leaves no second copy of a shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import fresh_path, read_file, stored, write_file
from askahead.llm.tokens import ID, crc32, encoder
from askahead.llm.wavelet import WaveletMatrix

END_ID = 1
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sQQ")
_MAGIC = b"TOKW"
_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("tokens", pa.int64())])


def pack_shard(ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """One shard file from the documents' ids and their token ids."""
    starts = np.cumsum([0, *map(len, tokens)]).astype("<i8")
    known = np.array([i is not None for i in ids], np.uint8)
    names = np.array([i or 0 for i in ids], "<i8")
    index = zstandard.ZstdCompressor(level=1).compress(names.tobytes() + known.tobytes() + starts.tobytes())
    matrix = WaveletMatrix.build(np.concatenate(tokens) if tokens else np.empty(0, np.uint32))
    return _HEAD.pack(_MAGIC, len(ids), len(index)) + index + matrix.to_bytes()


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(document ids, starts with the end appended, wavelet matrix) of a shard file."""
    magic, n, size = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    index = zstandard.ZstdDecompressor().decompress(data[_HEAD.size : _HEAD.size + size])
    names, known = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
    starts = np.frombuffer(index, "<i8", n + 1, 9 * n)
    ids = [int(i) if k else None for i, k in zip(names, known, strict=True)]
    return ids, starts, WaveletMatrix.from_bytes(data[_HEAD.size + size :])


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], ID).tobytes()
        for batch in batches:
            tokens = [np.frombuffer(encode(t or "") + end, ID) for t in batch.column(0).to_pylist()]
            # Two bytes hold every id of the usual vocabularies and halve what is shuffled.
            narrow = [t.astype("<u2").tobytes() if t.max() < 1 << 16 else t.tobytes() for t in tokens]
            columns = [batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(narrow, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "ids"])

    return run


def _write_shards(folder: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        part, shard, held = 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = pack_shard(ids, tokens)
            name, _ = write_file(folder, f"tokens-{part:06d}-{shard:06d}", ".wvm", lambda out: out.write(data))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "file": name, "tokens": held}], _MANIFEST)

        for batch in batches:
            for at, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = at
                ids.append(doc)
                tokens.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else ID))
                held += n
                if held >= shard_tokens:
                    yield flush()
                    ids, tokens, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> tuple[str, DataFrame]:
    """Write shard files; returns their folder and the manifest (part, shard, file, tokens, start).

    Documents follow one another in ascending id over parts and shards, null ids first, equal ids in the order of a
    hash of their tokens. A document lies in one shard; a shard is closed once it holds ``shard_tokens``. Null texts are empty, every
    document ends with ``end_id``. ``start`` counts the ids in all shards before. An empty table writes no file.
    """
    folder = fresh_path(docs.sparkSession, "token_shards")
    sized = (
        docs.select(F.col(text).alias("t"), F.col(id_col).cast("bigint").alias("id"))
        .mapInArrow(_tokenize(tokenizer, end_id), "id bigint, n bigint, ids binary")
    )
    # The range bounds are drawn from a sample of the ids; stored first so that texts are encoded once.
    sized = stored(sized, "token_ids")
    written = (
        sized.withColumn("tie", F.xxhash64("ids"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie", "ids")
        .select(F.spark_partition_id().alias("part"), "id", "n", "ids")
        .mapInArrow(_write_shards(folder, shard_tokens), "part int, shard int, file string, tokens bigint")
    )
    written = stored(written, "token_manifest")
    return folder, _with_starts(written)


def _with_starts(written: DataFrame) -> DataFrame:
    """Ids before each shard: sums over parts, whose number is set by the session, then within each part."""
    from pyspark.sql import Window

    parts = written.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        written.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "shard", "file", "tokens", (F.col("part_start") + F.col("inside")).alias("start"))
    )


_ROWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, starts, matrix = open_shard(read_file(folder, file))
                tokens = matrix.decode().astype(ID, copy=False)
                sums = [crc32(tokens[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(start + starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    schema=_ROWS,
                )

    return run


def read_tokens(folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shard files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("file", "start").repartition(n, "file").mapInArrow(
        _read_shards(folder), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.withColumnRenamed("id", id_col)
