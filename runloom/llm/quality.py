"""Quality rules: text statistics and decision lists that are learned from labels by sequential covering.

``statistics`` takes words as ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``learn`` grows conjunctions of thresholds that cover
rejected rows, prunes each on rows set aside, and stops where a rule no longer pays. The list becomes one ordered Spark
conditional expression: the first rule that holds rejects, none keeps.

Null and empty texts have no words: all counts are 0. Features with a null value don't occur; ratios of empty texts are 0.
Labels that are null, or name no document, teach nothing; labels of one class only give an empty list, which keeps all.
Repeated rows each count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, mix64, row_of, steps, words_of

#: Fixed values of the base statistics.
SYMBOLS, WINDOW = "#*$%&|<>", 8
#: Labelled rows that rules are learned from: a sample of about this many, chosen by hash.
LABELLED_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_echoes"]


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in characters]] = 1
    return out


_SPACE = _table(" \t\n\v\f\r")
#: Bytes that begin a code point of a word.
_IN_WORD = (((np.arange(256) & 0xC0) != 0x80) & (_SPACE == 0)).astype(np.uint8)
_KINDS = {"word_chars": _IN_WORD, "n_symbols": _table(SYMBOLS), "n_upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": _table("0123456789"), "n_stops": _table(".!?")}


def _repeats(codes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of words found at least twice in that text."""
    m = len(codes) - window + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if m > 0:
        row = row_of(bounds)
        start = np.flatnonzero(row[:m] == row[window - 1 :])
        h = np.zeros(len(start), np.uint64)
        salt = mix64(np.arange(len(bounds)).astype(np.uint64))
        for j in range(window):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[start + j].astype(np.uint64) + np.uint64(1))
        h += salt[row[start]]
        order = np.argsort(h)
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        a, b = start[order[same]], start[order[same + 1]]
        equal = row[a] == row[b]
        for j in range(window):
            equal &= codes[a + j] == codes[b + j]
        hit = np.unique(np.concatenate([a[equal], b[equal]]))
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])[bounds])


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    wordy = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    row = row_of(bounds)
    keep = wordy[codes] if len(codes) else np.zeros(0, bool)
    n = np.bincount(row[keep], minlength=len(texts))
    distinct = np.unique(row[keep] * (len(wordy) + 1) + codes[keep]) // (len(wordy) + 1)
    return n, n - np.bincount(distinct, minlength=len(texts))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts of COUNTS for each text."""
    codes, bounds, words = words_of(texts)
    raw, at = _bytes(texts)
    out = {"n_words": np.diff(bounds)}
    for name, table in _KINDS.items():
        out[name] = np.diff(np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])[at])
    out["n_lines"], out["n_dup_lines"] = _lines(texts)
    out["n_repeat_words"] = _repeats(codes, bounds)
    row = row_of(bounds)
    out["n_echoes"] = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=len(texts))
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of COUNTS, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                got = counts_of(as_array(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["id", *COUNTS])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS added; columns of those names are replaced."""
    keep, kinds = [c for c in docs.columns if c not in COUNTS], dict(docs.dtypes)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                got = counts_of(as_array(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*keep, *COUNTS])

    return docs.select(*keep).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + ", ".join(f"{c} bigint" for c in COUNTS))


def features() -> dict[str, Column]:
    """Features of the rules, as expressions over the counts."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "stops_per_word": per("n_stops", "n_words"),
        "echo_share": per("n_echoes", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, is_at_least, threshold) hold: reject."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, t in self.conditions:
            out &= (x[name] >= t) if at_least else (x[name] < t)
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gained on covered rejects when coverage narrows from (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the threshold of most gain until the rule covers rejects alone or nothing is gained."""
    conditions: list[tuple[str, bool, float]] = []
    rows = np.arange(len(bad))
    while len(conditions) < most and not bad[rows].all():
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        best = (1e-9, None)
        for name, values in x.items():
            v = values[rows]
            order = np.argsort(v, kind="stable")
            v, y = v[order], bad[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            below_p, below_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
            for at_least, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                gain = _gain(p.astype(float), n.astype(float), p0, n0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, at_least, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        rows = rows[Rule((best[1],)).holds({k: v[rows] for k, v in x.items()})]
    return Rule(tuple(conditions))


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    hit = rule.holds(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / max(1, p + n), p


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.97, least_cover: int = 5) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, keep the rule while it is precise there, take its rows away."""
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(bad)), []
    while len(rules) < most_rules and bad[left].sum() >= least_cover and not bad[left].all():
        aside = rng.random(len(left)) < 1 / 3
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        grow, prune = part(left[~aside]), part(left[aside])
        rule = _grow(*grow, most_conditions)
        while len(rule.conditions) > 1 and _worth(shorter := Rule(rule.conditions[:-1]), *prune)[0] >= _worth(rule, *prune)[0]:
            rule = shorter
        hit = rule.holds({k: v[left] for k, v in x.items()})
        covered = int((hit & bad[left]).sum())
        if not rule.conditions or covered < least_cover or covered < least_precision * hit.sum() or _worth(rule, *prune)[0] < 2 * least_precision - 1:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def sampled_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = LABELLED_ROWS) -> DataFrame:
    """id and label of about ``rows`` labelled rows, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from labelled statistics (label 0: reject), on about ``rows`` labelled rows."""
    f = features()
    got = stats.join(sampled_labels(labels, id_col, label_col, rows), "id").select("label", *(f[k].alias(k) for k in f)).toPandas()
    got = got.sort_values(list(f), kind="stable")
    return learn_rules({k: got[k].to_numpy(float) for k in f}, got["label"].to_numpy() == 0)


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from documents: only those of the labelled sample are counted. Its ids are sent to the tasks (about ``rows``)."""
    ids = sampled_labels(labels, id_col, label_col, rows).select(F.col("id").alias(id_col)).distinct()
    chosen = docs.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi")
    return learn(statistics(chosen, id_col, text_col), labels, id_col, label_col, rows)


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression over the counts: the number of the first rule that holds, else 0."""
    f, out = features(), None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, at_least, t in rule.conditions:
            test = test & ((f[name] >= t) if at_least else (f[name] < t))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    """Too few words, or over 30 in a hundred of them repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts with base_failed, rule (the first that holds, 0: none) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
