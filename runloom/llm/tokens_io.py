"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

``write`` makes a folder of two Parquet tables:

* ``rank``: one row per token id of the vocabulary (rank, token_id, n); rank 0 is the most frequent id of the whole table,
  ties go to the smaller id. It has at most vocabulary-size rows, so its broadcast is bounded.
* ``docs/shard=<k>``: one row per document, shards and the rows in them in ascending id order: place (in the shard), id,
  n_tokens, ``control`` and ``data``. A rank takes 1 to 4 little-endian bytes of ``data``; ``control`` holds ``bytes - 1`` of four ranks in each byte,
  lowest bits first. Both are binary columns.

``read`` decodes them by numpy table lookup: a 256-row table gives the four lengths of a control byte.

Null text is the empty text (end id only). Repeated ids keep one row each, their order among themselves is by a hash of the
text; however many rows one id has, they are spread over shards. Null ids come first.
Empty tables give empty files. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, steps
from runloom.llm.shared import fresh_path, stored
from runloom.llm.wordtok import tokenizer, with_end

#: Row k: how many bytes each of the four ranks under control byte k takes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
#: Where a document stands in the files, and its size.
KEYS = ["shard", "place", "id", "n_tokens"]
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of several documents, and their bounds in either."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    keep = np.arange(4, dtype=np.int8) < size[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[keep]
    data_bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[bounds]
    n = np.diff(bounds)
    control_bounds = np.concatenate([[0], np.cumsum((n + 3) // 4)])
    place = np.arange(len(ranks)) + np.repeat(4 * control_bounds[:-1] - bounds[:-1], n)  # each document begins a new byte
    slots = np.zeros(4 * control_bounds[-1], np.uint8)
    slots[place] = size - 1
    slots = slots.reshape(-1, 4)
    control = slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6
    return control, control_bounds, data, data_bounds


def decode_ranks(control: np.ndarray, control_bounds: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks that ``encode_ranks`` coded, n of them for each document."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(bounds[-1]) + np.repeat(4 * control_bounds[:-1] - bounds[:-1], n)
    size = LENGTHS[control].reshape(-1)[place]
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    word = padded[at] | padded[at + 1] << np.uint32(8)
    if len(size) and size.max() > 2:
        word |= padded[at + 2] << np.uint32(16) | padded[np.minimum(at + 3, len(padded) - 1)] << np.uint32(24)
    return word & _MASK[size - 1]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and each row's bounds in them."""
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def id_crcs(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, little-endian: two bytes each if the vocabulary fits in 65,536, else four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        kind = "<u2" if max(tok.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in steps(batch, "text"):
                ids, bounds = with_end(*tok.encode(as_array(part.column(1))), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), _binary(ids.astype(kind), bounds * np.dtype(kind).itemsize)], ["id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids binary")


def _width(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> str:
    """Encodes every text of ``docs`` and writes the files described above; returns their folder.

    One shuffle brings the texts into id order; each is then tokenised once, kept as plain ids under the shared folder,
    counted there and coded from there.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-files")
    vocab = max(tokenizer(path).vocab_size, end_id + 1)
    width = _width(vocab)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("content"))
    ordered = rows.repartitionByRange("id", "content").sortWithinPartitions("id", "content", "text")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    plain = stored(tokenised(ordered, path, end_id, "id", "text").withColumns({"shard": F.spark_partition_id(), "place": place}), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0].view(width), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token_id", "n"])

    counts = plain.select("ids").mapInArrow(count, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(vocab, np.int64)
    n[counts["token_id"]] = counts["n"]
    by_rank = np.lexsort((np.arange(vocab), -n))
    rank_of = np.empty(vocab, np.uint32)
    rank_of[by_rank] = np.arange(vocab)
    ranked = spark.createDataFrame(list(zip(range(vocab), by_rank.tolist(), n[by_rank].tolist(), strict=True)), "rank bigint, token_id bigint, n bigint")
    ranked.coalesce(1).write.parquet(f"{out}/rank")
    sent = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "ids"):
                raw, bounds = _flat(part.column(4))
                control, cb, data, db = encode_ranks(sent.value[raw.view(width)], bounds // np.dtype(width).itemsize)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], _binary(control, cb), _binary(data, db)], [*KEYS, "control", "data"])

    kind = dict(plain.dtypes)["id"]
    coded = plain.select(*KEYS, "ids").mapInArrow(code, f"shard int, place bigint, id {kind}, n_tokens bigint, control binary, data binary")
    coded.sortWithinPartitions("shard", "place").write.option("compression", "none").partitionBy("shard").parquet(f"{out}/docs")
    if not plain.take(1):  # an empty table has no shards: its schema stays
        coded.write.mode("overwrite").parquet(f"{out}/docs")
    return out


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/docs").withColumn("shard", F.col("shard").cast("int"))


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """The files decoded: shard, place, id, n_tokens, ids (array of int)."""
    return _decoded(spark, out, lambda ids, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), "ids array<int>")


def digest(spark: SparkSession, out: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the decoded files.

    Places come from the sizes of the shards before (one small row each) and a running sum within a shard.
    """
    got = _decoded(spark, out, lambda ids, bounds: pa.array(id_crcs(ids, bounds), pa.int64()), "ids_crc32 bigint")
    sizes = _files(spark, out).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return got.join(before, "shard").select("id", (F.col("before") + inside).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, out: str, make, column: str) -> DataFrame:
    files = _files(spark, out)
    token_of = np.array([r[0] for r in spark.read.parquet(f"{out}/rank").orderBy("rank").select("token_id").collect()], np.uint32)
    sent = spark.sparkContext.broadcast(token_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "data"):
                n = part.column(3).to_numpy()
                control, bounds = _flat(part.column(4))
                ids = sent.value[decode_ranks(control, bounds, _flat(part.column(5))[0], n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], make(ids, np.concatenate([[0], np.cumsum(n)]))], [*KEYS, column.split()[0]])

    return files.select(*KEYS, "control", "data").mapInArrow(run, f"shard int, place bigint, id {dict(files.dtypes)['id']}, n_tokens bigint, {column}")
