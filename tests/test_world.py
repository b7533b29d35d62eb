"""Voxels, isosurfaces, region files, levels, generators, streams and options."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom import config
from runloom.operators import reduce, voxels
from runloom.operators import tensor as T
from runloom.sources import levels, synthetic, world
from runloom.streaming import updates


def tag(value):
    if isinstance(value, dict):
        return 10, b"".join(bytes([k]) + struct.pack(">H", len(n)) + n.encode() + body for n, v in value.items() for k, body in [tag(v)]) + b"\0"
    if isinstance(value, list):
        parts = [tag(v) for v in value]
        return 9, bytes([parts[0][0] if parts else 0]) + struct.pack(">i", len(parts)) + b"".join(b for _, b in parts)
    if isinstance(value, np.ndarray):
        kind = {1: 7, 4: 11, 8: 12}[value.itemsize]
        return kind, struct.pack(">i", len(value)) + value.astype(value.dtype.newbyteorder(">")).tobytes()
    if isinstance(value, str):
        return 8, struct.pack(">H", len(value)) + value.encode()
    return 3, struct.pack(">i", value)


def region(chunks):
    heads, body = np.zeros(1024, ">u4"), b""
    for k, c in enumerate(chunks):
        raw = zlib.compress(b"\x0a\0\0" + tag(c)[1])
        data = struct.pack(">IB", len(raw) + 1, 2) + raw
        data += b"\0" * (-len(data) % 4096)
        heads[k] = (2 + len(body) // 4096) << 8 | len(data) // 4096
        body += data
    return heads.tobytes() + b"\0" * 4096 + body


def pack(places, bits, aligned):
    total, out = 0, []
    if aligned:
        per = 64 // bits
        return np.array([sum(int(p) << (bits * j) for j, p in enumerate(places[i : i + per])) for i in range(0, len(places), per)], np.uint64).view(np.int64)
    for j, p in enumerate(places):
        total |= int(p) << (bits * j)
    while len(out) * 64 < bits * len(places):
        out.append(total >> (64 * len(out)) & (2**64 - 1))
    return np.array(out, np.uint64).view(np.int64)


def test_region_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    numbered = rng.integers(0, 4, 4096)
    places = np.repeat(rng.integers(0, 20, 512), 8)
    names = ["minecraft:air"] + [f"minecraft:b{k}" for k in range(19)]
    packed = {v: {"DataVersion": v, "Level": {"xPos": 1, "zPos": k, "Sections": [{"Y": 1, "Palette": [{"Name": n} for n in names], "BlockStates": pack(places, 5, v >= 2529)}]}} for k, v in enumerate((1500, 3000))}
    old = {"Level": {"xPos": 0, "zPos": 0, "Sections": [{"Y": 0, "Blocks": numbered.astype(np.int8)}, {"Y": 1}]}}
    (tmp_path / "r.0.0.mca").write_bytes(region([old, *packed.values()]))
    column = rng.integers(0, 3, (16, 16, 128))
    (tmp_path / "r.1.0.mcr").write_bytes(region([{"Level": {"xPos": 32, "zPos": 0, "Blocks": column.astype(np.int8).reshape(-1)}}]))
    blocks = world.read_world(spark, str(tmp_path))
    modern = blocks.where("path like '%mca'")
    t, low = world.world_tensor(modern)
    assert t.shape == (32, 32, 32) and low == (0, 0, 0)
    dense = t.to_numpy()
    assert dense[0:16, 0:16, 0:16].reshape(-1).tolist() == numbered.tolist()
    ids = [world.block_id(n) for n in names]
    want = [ids[p] for p in places]
    assert dense[16:, 0:16, 16:].reshape(-1).tolist() == want == dense[16:, 16:, 16:].reshape(-1).tolist()
    other, _ = world.world_tensor(blocks.where("path like '%mcr'"))
    assert other.to_numpy().tolist() == column.transpose(2, 1, 0).tolist()
    assert {r["sections"] for r in world.world_statistics(blocks).collect()} == {3, 8}


def test_two_voxels(spark):
    a = np.zeros((3, 3, 3), np.int32)
    a[0, 0, 0], a[0, 0, 1] = 1, 2
    t = T.from_numpy(spark, a)
    vertices, triangles = voxels.mesh(t, voxels.color_config(spark, {1: (1, 2, 3, 4), 2: (5, 6, 7, 8)}))
    assert vertices.count() == 40 and triangles.count() == 20
    assert voxels.mesh(t, voxels.color_config(spark, {2: (5, 6, 7, 8)}))[1].count() == 10
    assert voxels.bounding_box(t).first()["x1"] == 1


def test_isosurface_of_a_block_is_closed(spark):
    a = np.zeros((4, 4, 4), np.float32)
    a[1:3, 1:3, 1:3] = 1
    vertices, triangles = voxels.marching_cubes(T.from_numpy(spark, a))
    assert vertices.count() == vertices.select("id").distinct().count() == 24
    ids = {r["id"] for r in vertices.collect()}
    edges = {}
    for r in triangles.collect():
        for x, y in ((r["a"], r["b"]), (r["b"], r["c"]), (r["c"], r["a"])):
            assert x in ids
            edges[x, y] = edges.get((x, y), 0) + 1
    assert all(edges.get((y, x)) == n for (x, y), n in edges.items())


@pytest.mark.parametrize("case", [0, 255, 1, 60, 105, 150, 126])
def test_case_triangles_use_exactly_the_crossed_edges(case):
    crossed = {(k, axis) for k in range(8) for axis in range(3) if not k >> axis & 1 and (case >> k & 1) != (case >> (k | 1 << axis) & 1)}
    assert {e for tri in voxels.case_triangles(case) for e in tri} == crossed


def test_levels_and_generators(spark, tmp_path):
    t = synthetic.run_length_array(spark, 5000, 600, 30, False, 3)
    levels.dump(t, str(tmp_path / "level"))
    again = levels.load(spark, str(tmp_path / "level"))
    assert again.to_list() == t.to_list() and again.shape == (5000,)
    assert reduce.count_nonzero(t).first()[0] > 300
    assert synthetic.banded(spark, 10, 3).to_list() == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    rows = ["label,p0,p1,p2,p3", "1,0,128,255,3", "7,9,0,0,200"]
    (tmp_path / "d.csv").write_text("\n".join(rows))
    assert synthetic.digits(spark, str(tmp_path / "d.csv"), 2).to_numpy().tolist() == [[0, 128], [255, 3], [9, 0], [0, 200]]


def test_streamed_updates(spark, tmp_path):
    rows = [(0, 0, 4, 1), (1, 2, 6, 2), (2, 3, 4, 3)]
    spark.createDataFrame(rows, "seq bigint, start bigint, end bigint, val int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq bigint, start bigint, end bigint, val int").parquet(str(tmp_path / "in"))
    updates.append_updates(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert updates.snapshot(spark, str(tmp_path / "out"), 8).to_list() == [1, 1, 2, 3, 2, 2, 0, 0]


def test_options(spark):
    with config.config_scope(block=7):
        assert config.get_value("block") == 7
    assert config.get_all_values() == config.DEFAULTS
    with config.greedy_evaluation_scope():
        assert (T.from_list(spark, [1, 2]) + 1).text == "runs"
    with pytest.raises(KeyError):
        config.set_value("nothing", 1)


def test_formats(spark):
    t = T.from_list(spark, list(range(30)))
    assert t.format(10) == "[0, 1, 2, 3, 4, ..., 25, 26, 27, 28, 29]"
    assert T.from_numpy(spark, np.arange(6, dtype=np.int32).reshape(2, 3)).format() == "[[0, 1, 2], [3, 4, 5]]"
    assert "2 sources" in (t[1:] + t[:-1]).explain()
