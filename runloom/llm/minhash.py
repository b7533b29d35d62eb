"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star-shaped pairs.

A document is the set of its distinct five-word shingles (ASCII letters lower-cased, words split at ASCII white space).
One hash per shingle fills ``BANDS * ROWS`` bins with the least hash of each bin's range; an empty bin borrows from the bin
that its own fixed probe sequence meets first. Documents of equal sets form a class and only one row of a class goes on.
Classes that share a band share a bucket. A bucket of k classes gives k - 1 candidate pairs, each class with the bucket's
centre, not k * k; pairs are confirmed on full sets. Where a bucket still holds several components, a further round takes
another centre, and at last the classes outside the bucket's largest component are compared with the classes of other
components, unless sizes, shingles that only one of them has or bit sketches rule a link out. So no link between components is lost to the star shape.

With 21 bands of 6 rows a pair of similarity 0.85 shares a bucket with probability over 0.9999; below that the bands have 5
rows, and 25 of them catch a pair of 0.8 as surely.

Null and empty texts and texts without words have the empty set: no links. Fewer than five words: the whole sequence is
the one shingle. ``id`` names a document: rows that repeat one exactly are the same document. A null id names none: such a row
links with nothing, has no component and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, as_list, mix64, row_of, steps, words_of
from runloom.llm.graph import components
from runloom.llm.shared import stored

WORDS, BANDS, ROWS = 5, 21, 6
#: Bands and rows below 85 percent.
LOOSE_BANDS, LOOSE_ROWS = 25, 5
#: Rounds after the first star; the last is the exact remainder.
ROUNDS = 2
#: A sketch of 126 bits rules a pair out below this similarity: over five standard deviations under the threshold.
SKETCH_LEAST = 0.55
#: Longs of the Bloom filter of the documents that share a bucket: it bounds what is broadcast, and lets about 9 percent of the others through at 1.6 million.
SLOTS = 1 << 18
#: How many rows of a plain table the test of a pair or a text read for it, and a row with bands, are worth.
PAIR_ROWS, BAND_ROWS = 200, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fold(parts) -> np.ndarray:
    """One hash of several columns of hashes, in order."""
    out = None
    for x in parts:
        out = mix64(x) if out is None else mix64(out * _STEP + x)
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after the other, and the texts' bounds in them."""
    import xxhash

    codes, bounds, names = words_of(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, as_list(names)), np.uint64, len(names))[codes]
    n = np.diff(bounds)
    m = max(0, len(hashes) - words + 1)
    whole = _fold([hashes[j : j + m] for j in range(words)]) if m else np.zeros(0, np.uint64)
    sets = []
    for a, k in zip(bounds[:-1].tolist(), n.tolist(), strict=True):
        if k >= words:
            sets.append(np.unique(whole[a : a + k - words + 1]))
        elif k:
            sets.append(_fold([np.array([k], np.uint64), *(hashes[a + j : a + j + 1] for j in range(k))]))
        else:
            sets.append(np.zeros(0, np.uint64))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def bins_of(flat: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """The densified one-permutation signature of every set that isn't empty: a row of ``bins`` hashes for each."""
    edges = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
    rows = np.flatnonzero(np.diff(bounds))
    sig, full = np.zeros((len(rows), bins), np.uint64), np.zeros((len(rows), bins), bool)
    for r, d in enumerate(rows.tolist()):
        own = flat[bounds[d] : bounds[d + 1]]
        at = np.searchsorted(own, edges)
        full[r] = np.diff(at, append=len(own)) > 0
        sig[r] = own[np.minimum(at, len(own) - 1)]
    r, i = np.nonzero(~full)
    attempt = 0
    while len(r):
        j = (mix64(i.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[r, j]
        sig[r[hit], i[hit]] = sig[r[hit], j[hit]]
        r, i, attempt = r[~hit], i[~hit], attempt + 1
    return sig


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """id, n (set size), h1 and h2 (hash of the set), bands (bucket keys; null for the empty set), bits (two longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in steps(batch, "text"):
                flat, bounds = shingle_sets(as_array(part.column(1)), words)
                n = np.diff(bounds)
                raw = memoryview(flat.view(np.uint8))
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)
                sig = bins_of(flat, bounds, bands * rows)
                keys = np.stack([_fold([np.full(len(sig), b, np.uint64), *(sig[:, b * rows + j] for j in range(rows))]) for b in range(bands)], 1)
                bits = np.zeros((len(sig), 128), np.uint8)
                bits[:, : bands * rows] = mix64(sig) & np.uint64(1)
                bits = np.packbits(bits, axis=1).view("<i8")
                there = pa.array(n == 0)
                stops = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(stops * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), mask=there) for x in (keys, bits)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists], ["id", "n", "h1", "h2", "bands", "bits"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, h1 bigint, h2 bigint, bands array<bigint>, bits array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union of their full shingle sets."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text_a"):
                sides = []
                for column in (2, 3):
                    coded = as_array(part.column(column)).dictionary_encode()  # a centre's text comes many times
                    sides.append((coded.indices.to_pylist(), *shingle_sets(coded.dictionary, words)))
                (ia, fa, ba), (ib, fb, bb) = sides
                keep = []
                for i, j in zip(ia, ib, strict=True):
                    x, y = fa[ba[i] : ba[i + 1]], fb[bb[j] : bb[j + 1]]
                    both = 0
                    if len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _sketch_similarity(x: str, y: str, bins: int):
    differ = F.bit_count(F.col(f"{x}.bits")[0].bitwiseXOR(F.col(f"{y}.bits")[0])) + F.bit_count(F.col(f"{x}.bits")[1].bitwiseXOR(F.col(f"{y}.bits")[1]))
    return 1 - 2 * differ / bins


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int | None = None, rows: int | None = None, words: int = WORDS) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links, itself included), kept."""
    bands, rows = bands or (BANDS if percent >= 85 else LOOSE_BANDS), rows or (ROWS if percent >= 85 else LOOSE_ROWS)
    sk = stored(sketches(docs, id_col, text_col, bands, rows, words), "sketches")
    least = F.min(F.struct("id", "n", "bands", "bits")).alias("least")  # equal sets have equal bands and bits
    reps = stored(sk.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(least).select("h1", "h2", "least.*"), "classes", rows=BAND_ROWS * sk.count())
    exploded = reps.select("id", F.explode("bands").alias("key"))
    classes = reps.count()
    n = bands * classes
    # tables of one row a bucket are stored, so joins with them shuffle rows as they are and a hot bucket's are split at run time
    shared = stored(exploded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("k")).where("k > 1").select("key", "centre"), "shared", rows=n)
    members = stored(exploded.join(shared, "key"), "buckets", rows=n)
    n = members.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = stored(_likely(texts, members).dropDuplicates(["id"]), "texts")
    pairs = members.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    tested = stored(pairs, "tested", rows=n)
    done, known = tested.count(), texts.count()
    found = components(stored(confirmed(tested, texts, percent, words), "confirmed", rows=PAIR_ROWS * max(done, known)), most=done)
    mixed, n = _mixed(members, found, n)
    sized = None
    for turn in range(1, ROUNDS + 1):
        if n and sized is None:
            sized = stored(_sized(mixed, reps, texts, percent, words, n), "sized", rows=BAND_ROWS * classes)
            members = stored(mixed.select("key", "id").join(sized.select("id"), "id", "left_semi"), "buckets", rows=n)
            mixed, n = _mixed(members, found, n)
        if not n:
            break
        if turn < ROUNDS:
            # the member that has the least to itself: most copies of one source are nearest to it
            rank = F.struct(-F.col("common") / F.col("n"), F.xxhash64("id", F.lit(turn)), "id")
            centres = stored(mixed.join(sized, "id").groupBy("key").agg(F.min_by(F.struct("id", "component"), rank).alias("c")), "centres", rows=n)
            more = mixed.join(centres, "key").where("component != c.component").select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b"))
            more = stored(more.distinct().join(tested, ["a", "b"], "left_anti"), "tested", rows=n + done)
        else:
            more = _remainder(mixed, sized, bands * rows, percent, n)
            more = stored(more.distinct().join(tested, ["a", "b"], "left_anti"), "tested")
        k = more.count()
        if not k:
            continue
        tested = tested.unionByName(more)
        new = stored(confirmed(more, texts, percent, words), "confirmed", rows=PAIR_ROWS * max(k, known))
        if k := new.count():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new), most=found.count() + k)
            if turn < ROUNDS:
                mixed, n = _mixed(members, found, n)
    named = sk.join(reps.select(F.col("id").alias("rep"), "h1", "h2"), ["h1", "h2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    out = named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _likely(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id a Bloom filter of the members' ids knows: all of the members, and few others."""
    h = F.xxhash64("id")
    slot, mask = F.pmod(h, F.lit(SLOTS)).cast("int"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 58) AS int))")
    known = members.select(slot.alias("slot"), mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    return texts.withColumn("slot", slot).join(F.broadcast(known), "slot").where(F.col("mask").bitwiseAND(mask) != 0).select("id", "text")


def _mixed(members: DataFrame, found: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Members (key, id, component) of the buckets that hold more than one component, of ``most`` rows, and how many these are."""
    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    keys = stored(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "keys", rows=most)
    mixed = stored(named.join(keys, "key", "left_semi"), "mixed", rows=most)
    return mixed, mixed.count()


def _own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """id and how many shingles of its text no other of the ``texts`` has (documents without any are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                flat, bounds = shingle_sets(as_array(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row_of(bounds))), pa.array(flat.view(np.int64))], ["id", "shingle"])

    rows = texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, shingle bigint")
    return rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("own"))


def _sized(mixed: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, words: int, most: int) -> DataFrame:
    """id, bits, bands, n and how many shingles are in common with any other, of the documents that can be linked to another at all."""
    ids = stored(mixed.select("id").distinct(), "ids", rows=most)
    own = _own_shingles(texts.join(ids, "id", "left_semi"), words)
    sized = reps.select("id", "bits", "bands", "n").join(ids, "id", "left_semi").join(own, "id", "left")
    return sized.select("id", "bits", "bands", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")).where(F.col("common") * 100 >= F.col("n") * percent)


def _remainder(mixed: DataFrame, sized: DataFrame, bins: int, percent: int, most: int) -> DataFrame:
    """Pairs of a bucket from different components, one of them outside the bucket's largest component.

    Two texts share no shingle that is one's own, which bounds their intersection from above: most pairs that aren't linked
    go by that bound, without being compared.
    """
    sizes = mixed.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = stored(sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main")), "main", rows=most)
    rows = stored(mixed.join(main, "key").join(sized, "id"), "remainder", rows=BAND_ROWS * most)
    x, y = rows.where("component != main").alias("x"), rows.alias("y")
    most = F.least("x.common", "y.common")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (most * 100 >= percent * (F.col("x.n") + F.col("y.n") - most)) & (_sketch_similarity("x", "y", bins) >= SKETCH_LEAST)
    near = near & (F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands")))  # one of the buckets that both share
    return x.join(y, near).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
