"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter over its most frequent n-grams. The filters are bit-sliced: slot s of one table holds a
bit for each language, so the AND of an n-gram's slots gives all languages whose filter holds it. A text's popcounts per
language, corrected for each filter's false-positive rate, are divided by the number of its n-grams; the largest decides.

Texts are lower-cased and everything but letters becomes one space; n-grams are of UTF-8 bytes, white space included.

Null texts and texts without a letter: ``und`` with score 0. A text with letters always gets a learned language: where no
n-gram is known, and in ties, the language with most training texts, then the first by name. Rows without a language or a
text teach nothing. No training rows at all: ``und`` everywhere. Repeated rows each count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, mix64, steps

#: n-gram bytes (at most 8), n-grams kept per language, table slots (a power of two), probes.
GRAM, TOP, SLOTS, PROBES = 4, 6_000, 1 << 18, 3
#: Training texts per language, about: a bounded sample chosen by hash.
TRAIN_TEXTS = 3_000
UNKNOWN = "und"


@dataclass
class Filters:
    """Languages (most training texts first), the bit-sliced table and the languages' false-positive rates."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    gram: int = GRAM


def grams_of(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all texts as integers (some cross into the next text), and each text's first and last plus one."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " "), " ")
    empty = pc.equal(plain, "")
    plain = pc.if_else(empty, "", pc.binary_join_element_wise(" ", plain, " " * (gram - 2), ""))
    _, offsets, data = plain.buffers()
    bounds = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = np.uint32 if gram <= 4 else np.uint64
    m = max(0, len(raw) - gram + 1)
    out = np.zeros(m, kind)
    for j in range(gram):
        out |= raw[j : j + m].astype(kind) << kind(8 * j)
    return out, bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - gram + 1)


def slots_of(grams: np.ndarray, probes: int, slots: int) -> Iterator[np.ndarray]:
    """The table slots of every n-gram, probe by probe, from two halves of one hash."""
    h = mix64(grams)
    a, b = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for j in range(probes):
        yield (a + np.uint32(j) * b) & np.uint32(slots - 1)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | str = "doc_id", train_texts: int = TRAIN_TEXTS, gram: int = GRAM, top: int = TOP, slots: int = SLOTS, probes: int = PROBES) -> Filters:
    """Learns the filters from labelled rows; ``key`` seeds the choice of about ``train_texts`` texts per language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("draw"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if len(langs) > 64:
        raise ValueError("a bitmask holds 64 languages at most")
    if not langs:
        return Filters([], np.zeros(slots, np.uint64), np.zeros(0), gram)
    share = F.create_map(*(F.lit(v) for x in langs for v in (x, min(1.0, train_texts / counts[x]))))[F.col("lang")]
    chosen = rows.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                for lang in pc.unique(part.column(0)).to_pylist():
                    grams, first, last = grams_of(as_array(part.column(1).filter(pc.equal(part.column(0), lang))), gram)
                    inside = np.zeros(len(grams) + 1, np.int32)
                    np.add.at(inside, first[last > first], 1)
                    np.add.at(inside, last[last > first], -1)
                    found, n = np.unique(grams[np.cumsum(inside)[:-1] > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    total = chosen.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top).select("lang", "gram").toPandas()
    table = np.zeros(slots, np.uint64)
    for k, lang in enumerate(langs):
        own = best.loc[best["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint64)
        for at in slots_of(own, probes, slots):
            table[at] |= np.uint64(1 << k)
    filled = np.array([((table >> np.uint64(k)) & np.uint64(1)).mean() for k in range(len(langs))])
    return Filters(langs, table, filled**probes, gram)


def predict_array(texts: pa.Array, model: Filters, probes: int = PROBES) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    grams, first, last = grams_of(texts, model.gram)
    n = (last - first).astype(float)
    if not len(model.langs):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    kind = np.uint8 if len(model.langs) <= 8 else np.uint64
    table = model.table.astype(kind)
    held = None
    for at in slots_of(grams, probes, len(table)):
        held = table[at] if held is None else held & table[at]
    share = np.zeros((len(texts), len(model.langs)))
    for k in range(len(model.langs)):
        hits = np.zeros(len(grams) + 1, np.int32)
        np.cumsum((held >> kind(k)) & kind(1), out=hits[1:])
        share[:, k] = (hits[np.minimum(last, len(grams))] - hits[np.minimum(first, len(grams))]) / np.maximum(n, 1)
    share = np.clip((share - model.false_rate) / (1 - model.false_rate), 0, 1)
    best = share.argmax(1)
    known = n > 0
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share.max(1), 0.0)


def predict(docs: DataFrame, model: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kinds = dict(docs.dtypes)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                langs, score = predict_array(as_array(part.column(at)), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
