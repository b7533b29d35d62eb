"""Near-duplicates of texts and vectors, against all pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

from runloom.llm import graph, minhash, vectors


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def brute(texts, percent=85):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(len(sets), links)
    return {k: (len(sets[k]), comp[k], comp[k] == k) for k in range(len(sets))}


def result(df):
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_edge_cases(docs, texts):
    assert result(minhash.near_duplicates(docs, 85)) == brute(texts)
    assert minhash.near_duplicates(docs).count() == len(texts) + 1
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_a_family_of_edited_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    texts = []
    for k in range(140):
        words = list(base)
        for at in rng.integers(0, 120, k % 7):
            words[at] = f"edit{rng.integers(0, 60)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for percent in (85, 80):
        assert result(minhash.near_duplicates(df, percent)) == brute(texts, percent)


def test_small_tables_take_few_tasks(spark, monkeypatch):
    files = {}

    def spy(df, name, *args, real=minhash.stored, **named):
        out = real(df, name, *args, **named)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    for module in (minhash, graph):
        monkeypatch.setattr(module, "stored", spy)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    texts = [" ".join(f"edit{k}" if at in rng.integers(0, 120, k % 7) else w for at, w in enumerate(base)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert result(minhash.near_duplicates(df, 85)) == brute(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k for k, n in files.items() if max(n) > 1} <= {"sketches", "texts", "tested"} and files["tested"][0] == 1
    # links that are stars already take no round
    files.clear()
    assert graph.components(spark.range(1, 9).select(F.col("id").alias("a"), F.lit(0).alias("b")), most=8).count() == 9
    assert [(k, len(n)) for k, n in files.items()] == [("links", 1), ("components", 1)]


def test_texts_of_no_bucket_go_before_the_shuffle(spark):
    texts = spark.range(20_000).withColumn("text", F.lit("a text"))
    members = spark.range(0, 20_000, 10).select("id", F.lit(1).alias("key"))
    likely = minhash._likely(texts, members.unionByName(members))
    assert likely.join(members, "id").count() == 2_000
    assert likely.count() < 2_100


def test_null_ids_link_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (4, text), (9, text), (None, None)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).select("n_shingles", F.coalesce("id", F.lit(-1)), F.coalesce("component_id", F.lit(-1)), "kept").collect())
    assert got == [(0, -1, -1, True), (26, -1, -1, True), (26, 4, 4, True), (26, 9, 4, False)]


def test_real_documents(real):
    rows = [r["text"] for r in real.orderBy("doc_id").collect()]
    assert result(minhash.near_duplicates(real)) == brute(rows, 80)


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(links.unionByName(links).unionByName(spark.createDataFrame([(50, 50), (None, 3)], "a bigint, b bigint")))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(41)}
    assert graph.components(links.where("false")).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 500)] + 0.12 * rng.standard_normal((500, 16)), rng.standard_normal((300, 16))]).astype(np.float32)
    v[7] = v[6]
    label = rng.integers(0, 2, len(v)).tolist()
    label[6] = label[7] = 1
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows = [(k, x.tolist(), label[k], "clash") for k, x in enumerate(v)] + [(800 + k, x, 1, "clash") for k, x in enumerate(bad)] + [(900, v[0].tolist(), None, "clash"), (901, v[0][:8].tolist(), label[0], "clash")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rep string")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, block=64).collect()}
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array(label)[:, None] == np.array(label)
    near = (x @ x.T >= 0.93) & same & ~np.eye(len(x), dtype=bool)
    comp = components(len(x), zip(*(a.tolist() for a in np.nonzero(np.triu(near)))))
    links = near.sum(1)
    assert sum(got[k][0] for k in range(len(x))) >= 0.99 * links.sum() and all(got[k][0] <= links[k] for k in range(len(x)))
    assert np.mean([got[k][1] == comp[k] for k in range(len(x))]) > 0.99
    assert all(got[k] == (0, k, True) for k in [*range(800, 806), 900, 901])
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_a_crowded_label(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2, 64))
    v = np.concatenate([base[0] + 0.001 * rng.standard_normal((700, 64)), base[1] + 0.05 * rng.standard_normal((700, 64)), rng.standard_normal((600, 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, block=64).collect()}
    assert [got[k] for k in range(2000)] == [(699, 0)] * 700 + [(699, 700)] * 700 + [(0, k) for k in range(1400, 2000)]
