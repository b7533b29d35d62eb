"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a group (label and dimension) by random sign hashes concatenated into one key, most
significant first (equal keys by a hash of vector and pass), and cuts the order into blocks of ``BLOCK`` vectors. A block is compared
with itself and with the block before it, in double precision, by matrix products. Vectors that agree on the first
log2(group / BLOCK) hashes are a run, and a run that spans more than two blocks (close copies crowd into few keys) has all
pairs of its blocks compared, in tiles of ``TILE`` blocks, each pair of tiles its own task group. A pair that an earlier pass
has compared is left to that pass, so links are counted once without ever writing pairs. A window gives out one row per
linked vector: how many it is linked to, and the smallest vector of its component within the window. The vectors of a
crowded run go to as many windows as it has tiles. Equal vectors of a label form a class beforehand and one row of a class
goes on.

A pair at the threshold angle agrees on a hash with probability 1 - angle / pi (0.88 for 0.93), so every pass compares it
with that to the power of log2(group / BLOCK) at least, however the vectors are spread; closer pairs more often. A group
takes ``PASSES`` passes, or as many as miss no more than ``MISS`` of the pairs at the threshold.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor does a null label; vectors of
different dimension don't link. A null vec_id names no vector: it links with nothing and is kept. Repeated vec_ids count as one vector each in n_links and share a component. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.graph import components
from runloom.llm.shared import stored

BLOCK, PASSES, HASHES = 512, 12, 32
#: Blocks of a tile; share of the pairs at the threshold that all passes of a group together may miss.
TILE, MISS = 4, 1e-3
#: Rows of a window that are compared at once.
STEP = 256
WINDOWS = "array<struct<crowd: int, window: int, other: int>>"


def projection_keys(table: pa.Array, dim: int, passes: int = PASSES, hashes: int = HASHES) -> np.ndarray:
    """Per vector and pass the concatenated sign hashes as one integer; planes depend on the dimension only."""
    x = table.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    planes = np.random.default_rng(dim).standard_normal((dim, passes * hashes))
    signs = (x @ planes > 0).reshape(len(x), passes, hashes)
    return signs @ (1 << np.arange(hashes - 1, -1, -1, dtype=np.int64))


def _with_keys(classes: DataFrame, passes: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(1), batch.column(2).to_numpy()
            keys = np.zeros((batch.num_rows, passes), np.int64)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                keys[rows] = projection_keys(vectors.take(pa.array(rows)), d, passes, hashes)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * passes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["rep", "keys"])

    return classes.select("rep", "vector", "dim").mapInArrow(run, f"rep {dict(classes.dtypes)['rep']}, keys array<bigint>")


def _groups(classes: DataFrame, threshold: float, passes: int, hashes: int, block: int) -> DataFrame:
    """label, dim, bits (hashes that a run agrees on) and turns (passes) of every group."""
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / block)), F.lit(0)), F.lit(hashes)).cast("int")
    turns = F.ceil(float(np.log(MISS)) / F.log1p(-F.pow(F.lit(float(agree)), F.col("bits")))).cast("int")  # null for no bits
    return classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("bits", bits).select("label", "dim", "bits", F.greatest(F.lit(passes), turns).alias("turns"))


def _blocks(classes: DataFrame, threshold: float, passes: int, hashes: int, block: int) -> DataFrame:
    """rep, and for every pass its block and the first and last block of its run if that is crowded (else -1).

    All from one sorted table: place in the task, plus what tasks before hold of the group.
    """
    groups = stored(_groups(classes, threshold, passes, hashes, block), "groups")
    most = groups.agg(F.max("turns")).first()[0] or passes
    keyed = classes.select("rep", "label", "dim").join(groups, ["label", "dim"]).join(_with_keys(classes, most, hashes), "rep")
    long = keyed.select("label", "dim", "rep", "bits", F.posexplode(F.slice("keys", F.lit(1), F.col("turns"))).alias("pass", "key"))
    long = long.select("*", F.xxhash64("rep", "pass").alias("tie"), F.expr(f"shiftright(key, {hashes} - bits)").alias("prefix"))
    group = ["label", "dim", "pass"]
    order = [*group, "key", "tie", "rep"]
    ordered = long.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.select(*group, "rep", "prefix", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "ordered")
    tasks = ordered.groupBy(*group, "task").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    running = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    tasks = tasks.select(*group, "task", (F.sum("n").over(running) - F.col("n") - F.col("first")).alias("shift"))
    b = F.floor((F.col("place") + F.col("shift")) / block).cast("int")
    ranked = ordered.join(tasks, [*group, "task"]).select(*group, "rep", "prefix", b.alias("b"))
    crowded = ranked.groupBy(*group, "prefix").agg(F.min("b").alias("run"), F.max("b").alias("last")).where("last - run > 1")
    ranked = ranked.join(crowded, [*group, "prefix"], "left")
    each = F.struct("pass", "b", F.coalesce("run", F.lit(-1)).alias("run"), F.coalesce("last", F.lit(-1)).alias("last"))
    return ranked.groupBy("rep").agg(F.array_sort(F.collect_list(each)).alias("bs")).select("rep", F.col("bs.b").alias("blocks"), F.col("bs.run").alias("runs"), F.col("bs.last").alias("lasts"))


def _compare(threshold: float):
    """One row per linked vector of a window: how many vectors it is linked to, and the component within the window."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        turn, crowd, window, other = (k.as_py() for k in key[2:])
        rep, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
        blocks, runs = (table[c].combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("blocks", "runs"))
        x = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1).astype(np.float64)
        place = blocks[:, turn] if crowd < 0 else (blocks[:, turn] - crowd) // TILE
        own = np.flatnonzero(place == window)
        rest = np.arange(len(rep)) if crowd < 0 else np.flatnonzero(place == other)
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        n, pairs = np.zeros(len(rep)), []
        for at in range(0, len(own), STEP):
            part = own[at : at + STEP]
            cosine = unit[part] @ unit[rest].T
            i, j = np.nonzero(cosine >= threshold - 1e-9)
            cosine = cosine[i, j]
            i, j = part[i], rest[j]
            keep = (place[j] < window) | (i < j)  # a pair of the own block or tile shows twice
            if crowd >= 0:
                keep &= np.abs(blocks[i, turn] - blocks[j, turn]) > 1
            for earlier in range(turn):
                keep &= (np.abs(blocks[i, earlier] - blocks[j, earlier]) > 1) & ((runs[i, earlier] < 0) | (runs[i, earlier] != runs[j, earlier]))
            i, j, cosine = i[keep], j[keep], cosine[keep]
            sure = cosine >= threshold + 1e-9
            near = np.flatnonzero(~sure)
            sure[near] = np.einsum("ij,ij->i", x[i[near]], x[j[near]]) / (norm[i[near]] * norm[j[near]]) >= threshold
            i, j = i[sure], j[sure]
            n += np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
            pairs.append((i.astype(np.int32), j.astype(np.int32)))
        i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int32) for k in (0, 1))
        least = rep.copy()
        while True:
            before = least.copy()
            np.minimum.at(least, i, before[j])
            np.minimum.at(least, j, before[i])
            if (least == before).all():
                break
        hit = np.flatnonzero(n)
        return pa.table({"rep": rep[hit], "n": n[hit].astype(np.int64), "least": least[hit]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", passes: int = PASSES, block: int = BLOCK, hashes: int = HASHES) -> DataFrame:
    """Per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    # cast to double first: the finite test and the zero test then see the values that are compared
    finite = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    valid = finite & F.exists("vector", lambda v: v != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    classes = rows.where("valid").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("dim", F.size("vector")), "classes")
    placed = classes.join(_blocks(classes, threshold, passes, hashes, block), "rep")
    placed = placed.select("*", F.posexplode(F.arrays_zip("blocks", "runs", "lasts")).alias("pass", "at"))
    window = lambda crowd, window, other: F.struct(crowd.cast("int").alias("crowd"), window.cast("int").alias("window"), other.cast("int").alias("other"))
    b, first = F.col("at.blocks"), F.col("at.runs")
    tile = F.floor((b - first) / TILE)
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.col("at.lasts") - first) / TILE).cast("int")), lambda t: window(first, F.greatest(tile, t), F.least(tile, t)))
    pairs = F.concat(F.array(*(window(F.lit(-1), x, F.lit(-1)) for x in (b, b + 1))), F.when(first < 0, F.array().cast(WINDOWS)).otherwise(tiles))
    windows = placed.select("label", "dim", "pass", F.explode(pairs).alias("w"), "rep", "weight", "vector", "blocks", "runs").select("*", "w.*").drop("w")
    kind = dict(rows.dtypes)["id"]
    links = windows.groupBy("label", "dim", "pass", "crowd", "window", "other").applyInArrow(_compare(threshold), f"rep {kind}, n bigint, least {kind}")
    links = stored(links, "links")
    found = components(links, "rep", "least")
    per_class = classes.join(links.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("label", "vector", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    same = (F.col("r.label") == F.col("c.label")) & (F.col("r.vector") == F.col("c.vector")) & F.col("r.valid")
    out = rows.alias("r").join(per_class.alias("c"), same, "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
