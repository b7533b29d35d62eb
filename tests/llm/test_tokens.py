"""Token files, packing, edit-aware counts and sampled pieces: against the tokenizers library and by round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm import editcount, packing, pieces, tokens_io
from runloom.llm.shared import stored

from .conftest import path

END = 1


@pytest.fixture(scope="module")
def encoded(texts):
    tok = Tokenizer.from_file(path())
    return [tok.encode(t or "", add_special_tokens=False).ids + [END] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts(n, seed=1):
    """Short texts of letters, marks, punctuation and spaces of all planes; letters that change when normalised come often."""
    import random
    import unicodedata

    rng = random.Random(seed)
    kinds = {}
    for c in range(0x110000):
        kinds.setdefault(unicodedata.category(chr(c))[0], []).append(chr(c))
    excluded = [c for c in kinds["L"] if unicodedata.normalize("NFC", c) != c]
    other = [c for k in "PSNZC" for c in kinds[k] if not 0xD800 <= ord(c) < 0xE000]
    pools = [("abcHTWYJAIsz019.,;:'!-\"#<|> \n\t ", 30), ("İıſKÅΣςẞŉǰẖ", 10), (excluded, 10), (kinds["L"], 15), (kinds["M"][:200], 14), (kinds["M"], 6), (other, 15)]
    pick = lambda: rng.choice(rng.choices([p for p, _ in pools], [w for _, w in pools])[0])
    return ["".join(pick() for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_ids_equal_the_library_on_any_unicode():
    import pyarrow as pa

    from runloom.llm.wordtok import WordTokenizer

    texts = odd_texts(100_000) + ["GAZETESİ, yeni", "SERGİSİ.", "İ .", "İ - Z", "T̈ H̱ W̊.", "x<|endoftext|>y", "<|ENDOFTEXT|>."]
    own = WordTokenizer(path())
    ids, bounds = own.encode(pa.array(texts))
    want = [e.ids for e in own.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for k, t in enumerate(texts) if ids[bounds[k] : bounds[k + 1]].tolist() != want[k]] == []


def test_starts_are_places_in_the_files(spark):
    rows = [(k % 7 if k % 3 else 3, f"text {k} " + "word " * (k % 11)) for k in range(400)] + [(None, "no id"), (None, None), (3, "text 3 word word word ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = tokens_io.write(docs, path(), END)
    files = tokens_io.read_ids(spark, out).orderBy("shard", "place").collect()
    assert [r["id"] is not None for r in files] == [False] * 2 + [True] * 401
    assert [r["id"] for r in files[2:]] == sorted(r["id"] for r in files[2:])
    want, start = [], 0
    for r in files:
        want.append((str(r["id"]), start, len(r["ids"]), crc(r["ids"])))
        start += len(r["ids"])
    assert sorted((str(r["id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens_io.digest(spark, out).collect()) == sorted(want)


def test_token_files_give_back_all_ids(spark, docs, encoded):
    out = tokens_io.write(docs, path(), END)
    rows = sorted(tuple(r) for r in tokens_io.digest(spark, out).select("id", "start", "n_tokens", "ids_crc32").collect())
    want, start = [], 0
    for k, ids in sorted([*enumerate(encoded), (5, encoded[5])], key=lambda x: x[0]):
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows == want
    assert {r["id"]: r["ids"] for r in tokens_io.read_ids(spark, out).collect()} == dict(enumerate(encoded))
    ranks = spark.read.parquet(f"{out}/rank").orderBy("rank").select("n").limit(50).collect()
    assert [r[0] for r in ranks] == sorted((r[0] for r in ranks), reverse=True)


def test_control_bytes_hold_every_width():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 3], np.uint32)
    bounds = np.array([0, 5, 5, 8])
    control, cb, data, _ = tokens_io.encode_ranks(ranks, bounds)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1
    assert tokens_io.decode_ranks(control, cb, data, np.diff(bounds)).tolist() == ranks.tolist()


def test_packing_is_whole_gapless_and_tight(docs, encoded):
    capacity = 512
    rows = packing.pack_documents(docs, path(), END, capacity).collect()
    every = [*enumerate(encoded), (5, encoded[5])]
    assert sorted((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(
        (k, p, p * capacity, len(part), crc(part)) for k, ids in every for p in range(-(-len(ids) // capacity)) for part in [ids[p * capacity : (p + 1) * capacity]]
    )
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seqs) <= -(-sum(len(ids) for _, ids in every) // capacity) + 1


def test_plan_packs_any_histogram():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64):
        hist = np.concatenate([[0], rng.integers(0, 40, capacity)])
        planned = packing.plan(hist)
        used = np.zeros_like(hist)
        for pattern, k in planned:
            assert sum(pattern) <= capacity and k > 0
            for length in pattern:
                used[length] += k
        assert used.tolist() == hist.tolist()
    assert packing.plan(np.zeros(9, np.int64)) == []


@pytest.fixture(scope="module")
def sizes():
    """Tokens of a whole text by the library, and the operator's vocabulary and pattern."""
    import public_tokenizers

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids), (path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def test_counts_after_edits_equal_full_counts(spark, docs, texts, sizes):
    size, by = sizes
    edits = F.array(F.struct(F.lit(3).alias("at"), F.lit(5).alias("cut"), F.lit(" new  word").alias("add")), F.struct(F.lit(10_000_000).alias("at"), F.lit(4).alias("cut"), F.lit("!\n").alias("add")))
    trees = editcount.plant(docs, *by).withColumn("edits", F.when(F.col("id") != 1, edits))
    got = {r["id"]: r for r in editcount.apply_edits(trees, *by).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        new = t if k == 1 else t[:3] + " new  word" + t[8:]
        new = new if k == 1 else new + "!\n"
        assert (got[k]["n_tokens"], got[k]["n_tokens_edited"], got[k]["n_chars_edited"], got[k]["text"]) == (size(t), size(new), len(new), new), k
    assert got[11]["n_chars_encoded"] < 10_000


def some_edit(rng, words, n):
    return rng.randint(0, n + 3), rng.choice([0, 1, 2, 9, 60]), "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 3, 200])))


def test_thousands_of_edits_equal_full_counts(sizes):
    size, by = sizes
    rng = random.Random(11)
    words = [" word", "a", " ", "  ", "\n", "1234", "'s", "!?", "é", "漢字", " The", "\t", "'", "🙂", "\u0301"]
    own = editcount.pre_tokens(*by)
    done = 0
    for _ in range(60):
        tree = editcount.CountTree.of("".join(rng.choice(words) for _ in range(rng.randint(0, 900))), own, rng.choice([1, 4, editcount.LEAF]))
        for _ in range(60):
            at, cut, add = some_edit(rng, words, len(tree.text))
            want = tree.text[:at] + add + tree.text[min(at, len(tree.text)) + cut :]
            tree.edit(at, cut, add)
            assert tree.text == want and tree.total == size(want)
            assert tree.chars[1] == len(want) and tree.sums[2, tree.base :].max() <= 2 * tree.leaf
            if rng.random() < 0.2:  # stored and read again
                tree = editcount.CountTree(tree.text, own, tree.kept(), tree.leaf)
            done += 1
    assert done == 3600


def test_a_large_insert_is_split(sizes):
    size, by = sizes
    tree = editcount.CountTree.of("short text", editcount.pre_tokens(*by))
    tree.edit(5, 0, " more words" * 30_000)
    before = tree.encoded
    for k in range(50):
        tree.edit(1000 + 6000 * k, 1, "x")
    assert tree.encoded - before < 50 * 2000 and tree.total == size(tree.text)


def test_stored_trees_take_batches_of_edits(spark, real, sizes):
    size, by = sizes
    trees = stored(editcount.plant(real, *by), "trees")
    now = {r["id"]: r["text"] or "" for r in trees.collect()}
    rng = random.Random(3)
    for _ in range(3):
        batch = {k: [some_edit(rng, [" word", "x", "\n", "42"], len(t)) for _ in range(rng.randint(1, 3))] for k, t in now.items() if rng.random() < 0.7}
        edits = spark.createDataFrame(list(batch.items()), "id bigint, edits array<struct<at: int, cut: int, add: string>>")
        trees = stored(editcount.apply_edits(trees.join(edits, "id", "left"), *by), "trees")
        for k, some in batch.items():
            for at, cut, add in some:
                at = min(at, len(now[k]))
                now[k] = now[k][:at] + add + now[k][at + cut :]
        got = {r["id"]: (r["text"], r["n_tokens_edited"]) for r in trees.collect()}
        assert got == {k: (t, size(t)) for k, t in now.items()}


def test_sampled_pieces_are_lossless_and_reproducible(docs, texts):
    model = path("piece_bpe_32k.model")
    a = {r["id"]: r["pieces"] for r in pieces.encode(docs, model, 3).collect()}
    b = {r["id"]: r["pieces"] for r in pieces.encode(docs.repartition(5), model, 3).collect()}
    assert a == b and a != {r["id"]: r["pieces"] for r in pieces.encode(docs, model, 4).collect()}
    back = {r["id"]: r["text"] for r in pieces.decode(pieces.encode(docs, model, 3), model).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert all(r["lossless"] for r in pieces.digest(docs, model, 3).collect())


def test_sampling_follows_the_lattice():
    import pyarrow as pa

    own = pieces.lattice(path("piece_bpe_32k.model"))
    ids, bounds = own.sample(pa.array(["then"] * 40_000), np.arange(40_000).astype(np.uint64))
    share = np.mean(np.diff(bounds) == 1)
    by_bytes = {own.bytes_of[i]: i for i in range(len(own.bytes_of)) if i not in set(own.byte_id.tolist())}
    total, word = 0.0, b"then"
    ways = [(0, 0.0)]
    while ways:
        at, w = ways.pop()
        if at == len(word):
            total += np.exp(w)
            continue
        ways += [(e, w + own.log_weight[by_bytes[word[at:e]]]) for e in range(at + 1, 5) if word[at:e] in by_bytes]
    assert abs(share - np.exp(own.log_weight[by_bytes[word]]) / total) < 0.01


def test_empty_tables(spark, docs):
    none = docs.where("false")
    by = path("byte_bpe_50k.json"), "."
    assert editcount.apply_edits(editcount.plant(none, *by).withColumn("edits", F.lit(None).cast("array<struct<at: int, cut: int, add: string>>")), *by).count() == 0
    assert tokens_io.digest(spark, tokens_io.write(none, path(), END)).count() == 0
    assert packing.pack_documents(none, path(), END).count() == 0
    assert pieces.digest(none, path("piece_bpe_32k.model")).count() == 0
