"""Token-id output by bit-plane shuffling.

Format: a folder of Parquet files, written and committed by Spark so that a lost executor leaves no half file. Each row is
one chunk of whole documents in ascending id order (null ids first): the chunk index (``shard``, ``chunk``, ``doc_ids``,
``lengths``, ``n_ids``, ``plane_bytes``) and ``payload``. The ids of a chunk are cut into fixed-size blocks; each block is
transposed into its byte planes (or bit planes), each plane is compressed with zstandard, and the planes stand one behind
the other. ``plane_bytes`` tells where each begins. High planes of small ids are all zero and shrink to a few bytes.

Null and empty texts give a document of the end id alone. Repeated document ids stay separate rows, next to each other, in
the order of a hash of their texts, so one id (or none) on very many rows is dealt over many shards. Only rows alike in id and
text have no order, and they need none.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK_SCHEMA = (
    "shard int, chunk int, width int, block int, bits boolean, n_ids long, doc_ids array<long>, lengths array<long>, "
    "plane_bytes array<int>, payload binary"
)


def pack_planes(ids: np.ndarray, block: int, bits: bool, level: int) -> tuple[list[int], bytes]:
    """Compressed planes of every block, and their lengths."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    out: list[bytes] = []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], "<u4").view(np.uint8).reshape(-1, 4)
        planes = np.unpackbits(part, axis=1, bitorder="little").T if bits else part.T
        for plane in planes:
            out.append(press.compress((np.packbits(plane) if bits else np.ascontiguousarray(plane)).tobytes()))
    return [len(p) for p in out], b"".join(out)


def unpack_planes(payload: bytes, sizes: list[int], n_ids: int, block: int, bits: bool) -> np.ndarray:
    """The ids again: the inverse of ``pack_planes``."""
    import zstandard

    press, each = zstandard.ZstdDecompressor(), 32 if bits else 4
    ends = list(itertools.accumulate(sizes))
    ids = np.empty(n_ids, "<u4")
    for k, at in enumerate(range(0, n_ids, block)):
        n = min(block, n_ids - at)
        rows = []
        for e, s in zip(ends[k * each : (k + 1) * each], sizes[k * each : (k + 1) * each], strict=True):
            plane = np.frombuffer(press.decompress(payload[e - s : e]), np.uint8)
            rows.append(np.unpackbits(plane, count=n) if bits else plane)
        part = np.ascontiguousarray(np.stack(rows, axis=1))
        part = np.packbits(part, axis=1, bitorder="little") if bits else part
        ids[at : at + n] = np.ascontiguousarray(part).view("<u4")[:, 0]
    return ids


def write_ids(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    chunk_ids: int = 1 << 20, block: int = 1 << 16, bits: bool = False, level: int = 3,
) -> None:
    """Encode ``docs`` and write the format at ``path``. One range shuffle by id gives ascending order over the shards; a
    shard is one task's range and holds its chunks in order. Memory: a chunk and one batch of texts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from listing_lake.llm.tokens import encoder

        encode, end, shard = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, names, held, chunk = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            sizes, payload = pack_planes(flat, block, bits, level)
            row = {
                "shard": shard, "chunk": chunk, "width": 4, "block": block, "bits": bits, "n_ids": len(flat), "doc_ids": list(names),
                "lengths": [len(x) // 4 for x in ids], "plane_bytes": sizes, "payload": payload,
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for name, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids.append(encode(text or "") + end)
                names.append(name)
                held += len(ids[-1]) // 4
                if held >= chunk_ids:
                    yield flush()
                    ids, names, held, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(CHUNK_SCHEMA))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    rows = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").drop("_hash")
    rows.mapInArrow(write, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each chunk. Sums within a shard come first; over all shards only one row each is left."""
    all_before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    totals = totals.select("shard", F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_base"))
    places = chunks.select("shard", "chunk", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_in"))
    return places.join(totals, "shard").select("shard", "chunk", (F.col("_base") + F.col("_in")).alias("_start"))


def read_ids(spark: SparkSession, path: str, *, keep_ids: bool = True) -> DataFrame:
    """Documents from the format: ``shard``, ``chunk``, ``doc_id``, ``inside`` (ids before it in its chunk), ``n_tokens``,
    ``ids_crc32`` and ``ids`` as little-endian uint32 bytes (null without ``keep_ids``: then they never leave the worker).
    Each chunk decodes on its own; ``chunk_starts`` gives its place in the whole stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack_planes(row["payload"], row["plane_bytes"], row["n_ids"], row["block"], row["bits"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                each = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                columns = {
                    "shard": pa.array([row["shard"]] * len(ends), pa.int32()), "chunk": pa.array([row["chunk"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "inside": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    "ids": pa.array(each, pa.binary()) if keep_ids else pa.nulls(len(ends), pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    return chunks.mapInArrow(read, "shard int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")


def digest(docs: DataFrame, path: str, **parameters) -> DataFrame:
    """Write, read back, and describe each document's ids."""
    write_ids(docs, path, **parameters)
    spark = docs.sparkSession
    told = read_ids(spark, path, keep_ids=False).drop("ids")
    starts = chunk_starts(spark.read.schema(CHUNK_SCHEMA).parquet(path))
    return told.join(starts, ["shard", "chunk"]).select(
        "doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
