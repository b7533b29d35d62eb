"""The registered queries on a small table: columns and types of the contracts, and their rows against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm import langid, queries

from .conftest import path
from .test_dedup import brute
from .test_text import base_spans, said

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_edit_aware_counts": {"doc_id": "bigint", "n_tokens_edited": "bigint"},
    "op2_tag_path_ratios": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_sorted_projections": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_langid_filters": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_sampled_pieces": {"doc_id": "bigint", "lossless": "boolean"},
    "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.fixture(scope="module")
def rows(spark):
    cache = {}

    def get(name):
        if name not in cache:
            df = queries.QUERIES[name](spark, SF)
            kinds = dict(df.dtypes)
            assert {c: kinds.get(c) for c in TYPES[name]} == TYPES[name]
            cache[name] = df.collect()
        return cache[name]

    return get


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(table):
    tok = Tokenizer.from_file(path())
    keys = sorted(table)
    return {k: e.ids + [1] for k, e in zip(keys, tok.encode_batch_fast([table[k] or "" for k in keys], add_special_tokens=False))}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_every_query_is_typed():
    assert set(TYPES) == set(queries.QUERIES)


def test_tokens(rows, ids):
    start, want = 0, []
    for k in sorted(ids):
        want.append((k, start, len(ids[k]), crc(ids[k])))
        start += len(ids[k])
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rows("op5_token_files")) == want


def test_packing(rows, ids):
    got = rows("op10_best_fit_packing")
    want = sorted((k, p, 4096 * p, crc(x[4096 * p : 4096 * p + 4096])) for k, x in ids.items() for p in range(-(-len(x) // 4096)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_secrets(rows, table):
    for r in rows("op3_secret_scans"):
        spans = base_spans(table[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(said(spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert not spans or set(said(spans).split(",")) <= set(r["spans"].split(","))


def test_near_duplicates(rows, table):
    keys = sorted(table)
    want = {keys[k]: (n, keys[c], kept) for k, (n, c, kept) in brute([table[k] for k in keys]).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows("op8_minhash_near_dedup")} == want


def test_languages(spark, rows, table):
    """Against plain sets of n-grams and their shares, corrected for false positives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    import pyarrow as pa

    for r in rows("op7_langid_filters"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        grams, first, last = langid.grams_of(pa.array([table[r["doc_id"]] or ""]), model.gram)
        own = grams[first[0] : last[0]].tolist()
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        masks = {}
        for g in set(own):
            at = [int(x[0]) for x in langid.slots_of(np.array([g], grams.dtype), langid.PROBES, len(model.table))]
            masks[g] = int(model.table[at[0]]) if len(at) == 1 else int(np.bitwise_and.reduce([model.table[a] for a in at]))
        share = [sum(masks[g] >> k & 1 for g in own) / len(own) for k in range(len(model.langs))]
        fixed = [min(max((s - f) / (1 - f), 0), 1) for s, f in zip(share, model.false_rate)]
        assert r["lang_pred"] == model.langs[int(np.argmax(fixed))] and abs(r["score"] - max(fixed)) < 1e-9


def test_pages_and_pieces(rows):
    assert all(r["lossless"] for r in rows("op9_sampled_pieces"))
    assert all(r["n_chars"] == len(r["text"]) for r in rows("op2_tag_path_ratios"))


def test_edits(spark, rows, table):
    """The edits of the query, applied to plain texts and counted by the library."""
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    planned = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", queries.planned_edits().alias("edits")).collect()
    want = {}
    for r in planned:
        new = old = table[r["doc_id"]] or ""
        for e in r["edits"]:
            at = min(e["at"], len(new))
            new = new[:at] + e["add"] + new[at + e["cut"] :]
        want[r["doc_id"]] = (size(old), size(new), len(new))
    assert {r["doc_id"]: (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in rows("op1_edit_aware_counts")} == want


def test_stages_take_odd_tables(spark):
    """Null texts and ids, repeated rows, clashing names, no n_chars, empty tables."""
    import corpus_pipeline as p

    text = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 400 and 3000 and lang = 'en'").limit(1).first()["text"]
    other = " ".join(reversed(text.split()))
    data = [(1, text, "en", "mine"), (1, text, "en", "mine"), (2, text + " end", "en", "R"), (None, text, "en", "R"), (None, other, "en", "R"), (3, None, "en", "R"), (4, other + " token=abcdefabcdefabcdef01", "en", "R")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, score string").withColumns({c: F.lit("keep") for c in ("kept", "rule", "n_words", "lang_pred", "_spans", "_doc", "hash", "base_failed", "id")})
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.dtypes == docs.dtypes, name
        assert all(r["kept"] == r["n_words"] == r["lang_pred"] == r["_spans"] == r["id"] == "keep" and r["score"] in ("mine", "R") for r in got), name
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "4", "None", "None"]
        if name == "secret_scans":
            assert len(got) == len(data) and [r["text"] for r in got if r["doc_id"] == 4] == [other + " [SECRET]"]
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert p.best_fit_packing(spark, docs, SF).select("doc_id").count() >= len(data)
