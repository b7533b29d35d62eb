"""Voxel worlds: region files (.mca, .mcr) as block runs.

Spark reads whole region files (a few MB each, 32 x 32 chunks) as binaries; each task decodes its files' chunks with numpy and
gives out runs of 16 x 16 x 16 sections. Axes are x, z, y, as sections are stored. Numbered blocks keep their number; named
blocks have the crc32 of their name without the sign bit, air is 0. Chunks that can't be decoded raise.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.manipulate import assemble
from runloom.operators.tensor import StepTensor

SECTOR, SIDE = 4096, 16
#: From this data version on, packed numbers don't cross words.
ALIGNED_SINCE = 2529
SCHEMA = "path string, cx int, cy int, cz int, start bigint, end bigint, val int"
_NUMBERS = {1: "b", 2: "h", 3: "i", 4: "q", 5: "f", 6: "d"}
_ARRAYS = {7: ">i1", 11: ">i4", 12: ">i8"}


class TagReader:
    """Named binary tags: numbers, arrays, strings, lists and compounds, big-endian."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _take(self, form: str):
        out = struct.unpack_from(">" + form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return out

    def _string(self) -> str:
        n = self._take("H")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind in _NUMBERS:
            return self._take(_NUMBERS[kind])
        if kind in _ARRAYS:
            n, dtype = self._take("i"), np.dtype(_ARRAYS[kind])
            self.at += n * dtype.itemsize
            return np.frombuffer(self.data, dtype, n, self.at - n * dtype.itemsize)
        if kind == 8:
            return self._string()
        if kind == 9:
            inner, n = self._take("b"), self._take("i")
            return [self.value(inner) for _ in range(max(n, 0))]
        if kind == 10:
            out = {}
            while inner := self._take("b"):
                name = self._string()
                out[name] = self.value(inner)
            return out
        raise ValueError(f"no tag {kind}")


def read_tags(data: bytes) -> dict:
    """The root compound of a tag file, gzipped, zlib-packed or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    elif data[:1] == b"\x78":
        data = zlib.decompress(data)
    reader = TagReader(data)
    kind = reader._take("b")
    reader._string()
    return reader.value(kind)


def chunks(region: bytes) -> Iterator[dict]:
    """The decoded chunks of a region file."""
    for word in np.frombuffer(region, ">u4", 1024).tolist():
        if at := (word >> 8) * SECTOR:
            n, packed = struct.unpack_from(">IB", region, at)
            raw = region[at + 5 : at + 4 + n]
            yield read_tags({1: gzip.decompress, 2: zlib.decompress, 3: bytes}[packed](raw))


def unpack(words: np.ndarray, n: int, kinds: int, aligned: bool) -> np.ndarray:
    """n palette places packed into 64-bit words of max(4, log2) bits, across words or not."""
    bits = max(4, (kinds - 1).bit_length())
    words = words.astype(np.int64).view(np.uint64)
    if aligned:
        per = 64 // bits
        at = np.arange(n)
        return ((words[at // per] >> ((at % per) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    plane = ((words[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64).reshape(-1)[: n * bits].reshape(n, bits)
    return plane @ (1 << np.arange(bits, dtype=np.int64))


def block_id(name: str) -> int:
    name = name.removeprefix("minecraft:")
    return 0 if name in ("air", "cave_air", "void_air") else zlib.crc32(name.encode()) & 0x7FFFFFFF


def sections(chunk: dict) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First cell (x, z, y) and the 4096 block numbers, x fastest, then z, of every section that a chunk holds."""
    level = chunk.get("Level", chunk)
    x, z, version = level["xPos"] * SIDE, level["zPos"] * SIDE, chunk.get("DataVersion", 0)
    if "Blocks" in level:  # the older format: one column of 128, y fastest, then z
        column = np.asarray(level["Blocks"]).view(np.uint8).astype(np.int64).reshape(SIDE, SIDE, -1)
        for k in range(column.shape[2] // SIDE):
            yield x, z, k * SIDE, column[:, :, k * SIDE : (k + 1) * SIDE].transpose(2, 1, 0).reshape(-1)
    for s in level.get("Sections", level.get("sections", [])):
        states = s.get("block_states", {})
        palette, words = s.get("Palette", states.get("palette")), s.get("BlockStates", states.get("data"))
        if "Blocks" in s:
            ids = np.asarray(s["Blocks"]).view(np.uint8).astype(np.int64)
            if "Add" in s:
                high = np.asarray(s["Add"]).view(np.uint8).astype(np.int64)
                ids = ids + (np.stack([high & 15, high >> 4], 1).reshape(-1) << 8)
        elif palette is not None:
            names = np.array([block_id(p["Name"]) for p in palette], np.int64)
            ids = names[unpack(words, SIDE**3, len(palette), version >= ALIGNED_SINCE)] if words is not None else np.full(SIDE**3, names[0])
        else:
            continue
        yield x, z, s["Y"] * SIDE, ids


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            for chunk in chunks(bytes(content)):
                for x, z, y, ids in sections(chunk):
                    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                    yield pd.DataFrame({"path": path, "cx": x, "cy": z, "cz": y, "start": start, "end": np.append(start[1:], len(ids)), "val": ids[start]})


def read_world(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all sections of the region files under ``path``: cx, cy, cz (first cell's x, z, y), start, end, val."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mc[ar]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(_decode, SCHEMA)


def world_tensor(blocks: DataFrame) -> tuple[StepTensor, tuple[int, int, int]]:
    """All sections as one tensor of axes x, z, y, and its first cell; what no section holds is 0."""
    box = blocks.agg(*(f(c) for c in ("cx", "cy", "cz") for f in (F.min, F.max))).first()
    low, high = box[0::2], box[1::2]
    moved = blocks.select(*((F.col(c) - lo).alias(c) for c, lo in zip(("cx", "cy", "cz"), low, strict=True)), "start", "end", "val")
    return assemble(moved, (SIDE,) * 3, tuple(b - a + SIDE for a, b in zip(low, high, strict=True)), "i"), tuple(low)


def world_statistics(blocks: DataFrame, by: str = "path") -> DataFrame:
    """Per file: sections, cells, non-empty cells, runs, the ratio of cells to twice the runs, and the median run."""
    size = F.col("end") - F.col("start")
    out = blocks.groupBy(by).agg(F.countDistinct("cx", "cy", "cz").alias("sections"), F.sum(size).alias("cells"), F.sum(F.when(F.col("val") != 0, size).otherwise(0)).alias("filled"), F.count("*").alias("runs"), F.percentile(size, 0.5).alias("median_run"))
    return out.withColumn("ratio", F.col("cells") / (2 * F.col("runs")))
