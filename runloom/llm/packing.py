"""Best-fit packing of documents into sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers) comes to the driver. There, patterns of two to four
lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down to what the histogram holds, and what is left is packed best-fit from the longest. The plan is a list
of slots whose size depends on ``capacity``, not on the rows. Every piece then finds its slot from its rank among the pieces
of its length: ranks come from salted counts, so a length that a third of all pieces share is still spread over tasks.

Null text is the empty text: a piece of one end id. Repeated ids are pieces of their own. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, steps
from runloom.llm.shared import stored
from runloom.llm.tokens_io import id_crcs
from runloom.llm.wordtok import tokenizer, with_end

#: Patterns tried per length, and sweeps of the fit: both fix the driver's work for a given capacity.
TRIED, SWEEPS = 6, 12
#: Pieces that one salt of a length holds on average.
SALT_ROWS = 1_000_000


def patterns(hist: np.ndarray, tried: int = TRIED, seed: int = 7) -> list[tuple[int, ...]]:
    """Exactly filling patterns of two to four lengths of the histogram; ``hist[k]``: how many pieces have length k."""
    capacity = len(hist) - 1
    there = np.flatnonzero(hist[1:capacity]) + 1
    if not len(there):
        return []
    rng, found = np.random.default_rng(seed), set()
    share = hist[there] / hist[there].sum()
    for first in there.tolist():
        if hist[capacity - first]:
            found.add(tuple(sorted((first, capacity - first))))
        for more in (1, 2):
            for draw in rng.choice(there, (tried, more), p=share).tolist():
                last = capacity - first - sum(draw)
                if 0 < last and hist[last]:
                    found.add(tuple(sorted((first, *draw, last))))
    return sorted(found)


def fit_counts(hist: np.ndarray, tried: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares of ``hist`` by the patterns' length counts: coordinate descent, clipped at zero."""
    left = hist.astype(float).copy()
    x = np.zeros(len(tried))
    columns = [np.unique(p, return_counts=True) for p in tried]
    for _ in range(sweeps):
        for j, (at, times) in enumerate(columns):
            step = max(-x[j], float(times @ left[at]) / float(times @ times))
            if step:
                x[j] += step
                left[at] -= step * times
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; together they hold every piece of the histogram."""
    capacity, left = len(hist) - 1, hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    tried = patterns(left)
    fitted = fit_counts(left, tried)
    for j in np.argsort(-fitted, kind="stable").tolist():
        at, times = np.unique(tried[j], return_counts=True)
        if k := min(int(fitted[j] + 0.5), int((left[at] // times).min())):
            left[at] -= k * times
            out.append((tried[j], k))
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: all pieces of a length go together into the fullest open sequences that take them."""
    capacity = len(left) - 1
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(space: int, pattern: tuple[int, ...], k: int) -> None:
        if not room[space]:
            insort(rooms, space)
        room[space].append((pattern, k))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # nothing open takes it: as many as fit in new sequences
                if full := n // each:
                    put(capacity - each * length, (length,) * each, full)
                if rest := n % each:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            space = rooms[at]
            pattern, k = room[space].pop()
            if not room[space]:
                rooms.pop(at)
            used = min(n, k)
            if k > used:
                put(space, pattern, k - used)
            put(space - length, (*pattern, length), used)
            n -= used
    return [x for found in room.values() for x in found]


def slots(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as arrays ordered by length: first (rank over all lengths), sequence of that rank, offset in it."""
    rows, base = [], 0
    for pattern, k in planned:
        offset = 0
        for length in pattern:
            rows.append((length, k, base, offset))
            offset += length
        base += k
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    first = np.cumsum(table[:, 1]) - table[:, 1]
    return {"first": first, "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``. ``order`` names columns that tell rows apart."""
    spark = pieces.sparkSession
    counts = pieces.groupBy(length_col).count().collect()
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        hist[length] = n
    sent = spark.sparkContext.broadcast(slots(plan(hist), capacity))
    salts = max(8, int(hist.sum()) // SALT_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(length_col, "_salt", (F.sum("_n").over(group) - F.col("_n")).alias("_before"))
    starts = np.cumsum(hist) - hist
    rank = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", rank).join(before, [length_col, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kinds, names = dict(pieces.dtypes), pieces.columns
    at = names.index(length_col)
    sent_starts = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            rank = sent_starts.value[batch.column(at).to_numpy()] + batch.column(batch.num_columns - 1).to_numpy()
            slot = np.searchsorted(s["first"], rank, "right") - 1
            sequence, offset = s["sequence"][slot] + rank - s["first"][slot], s["offset"][slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def cut(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32. Only documents over ``capacity`` have more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, bounds = with_end(*tok.encode(as_array(part.column(1))), end_id)
                n = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[row] - start, capacity)
                stops = np.concatenate([bounds[row] + start, bounds[-1:]])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(id_crcs(ids, stops), pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut(docs, path, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, ["id", "piece", "ids_crc32"])
