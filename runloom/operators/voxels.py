"""Voxel grids: neighbours, exposed faces, meshes, isosurfaces, maps."""

from __future__ import annotations

from functools import reduce as fold
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import scalar
from runloom.operators import reduce as red
from runloom.operators.convolve import conv
from runloom.operators.manipulate import transpose
from runloom.operators.tensor import StepTensor, map_values, parts_of
from runloom.plans.align import align

#: Fixed bits of the neighbours: axis, side, bit.
FACES = [(0, -1, 1), (0, 1, 2), (1, -1, 4), (1, 1, 8), (2, -1, 16), (2, 1, 32)]


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def coordinates(pos: Column, shape: tuple[int, ...]) -> list[Column]:
    """x, y, z of a flat position."""
    w, h = shape[0], shape[1]
    return [pos % w, _div(pos, w) % h, _div(pos, w * h)]


def _indicator(t: StepTensor, test) -> StepTensor:
    return map_values(lambda c: F.when(test(c), 1).otherwise(0), t, kind="i")


def adjacency_mask(t: StepTensor) -> StepTensor:
    """Per filled cell the bits of the sides where nothing is; 0 for empty cells.

    One pass of difference events: every filled run tells its own cells and, with their bits, its neighbours' cells.
    """
    own = sum(bit for *_, bit in FACES) + 1
    kernel = np.zeros((3, 3, 3), np.int32)
    kernel[1, 1, 1] = own
    for axis, side, bit in FACES:
        kernel[tuple(1 + (side if k == axis else 0) for k in (2, 1, 0))] = bit
    told = conv(_indicator(t, lambda c: scalar.nonzero(c, t.kind)), kernel, 1)
    return map_values(lambda v: F.when(v >= own, 2 * own - 1 - v).otherwise(0).cast("int"), told, kind="i", text=f"adjacency({t.text})")


def walk(mask: StepTensor, *tensors: StepTensor) -> DataFrame:
    """pos and the tensors' values v0, v1 ... where the mask isn't zero."""
    every = [mask, *tensors]
    packed = [s for t in every for s in t.sources]
    ends, at = [], 0
    for t in every:
        ends.append((t, at))
        at += len(t.sources)
    if not packed:
        mask = mask._leaf(mask.frame())
        return walk(mask, *tensors)
    value = lambda c: F.struct(*(t.fn(c[k : k + len(t.sources)]).alias(f"v{j - 1}" if j else "m") for j, (t, k) in enumerate(ends)))
    rows = align(parts_of(packed), [scalar.SQL_TYPES[s.leaf.kind] for s in packed], mask.length, value)
    rows = rows.where(scalar.nonzero(F.col("val.m"), mask.kind))
    return rows.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), *(F.col(f"val.v{j}") for j in range(len(tensors))))


def exposed_faces(t: StepTensor) -> DataFrame:
    """x, y, z, val and face (0 to 5) of every exposed side."""
    sides = F.array(*(F.when(F.col("v0").bitwiseAND(F.lit(bit)) != 0, F.lit(k)) for k, (*_, bit) in enumerate(FACES)))
    mask = adjacency_mask(t)
    rows = walk(mask, mask, t)
    x, y, z = coordinates(F.col("pos"), t.shape)
    return rows.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col("v1").alias("val"), F.explode(F.array_compact(sides)).alias("face"))


def _corners(axis: int, side: int) -> list[tuple[int, int, int]]:
    """The four corners of a unit cell's side, in turn as seen from outside."""
    u, v = (axis + 1) % 3, (axis + 2) % 3
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    if side < 0:
        ring.reverse()
    out = []
    for a, b in ring:
        c = [0, 0, 0]
        c[axis], c[u], c[v] = int(side > 0), a, b
        out.append(tuple(c))
    return out


def mesh(t: StepTensor, colors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (quad, corner, position, normal, colour of the value) and triangles (corners of a quad) of the exposed sides.

    ``colors``: val, r, g, b, a; values without a colour aren't drawn.
    """
    faces = exposed_faces(t)
    if colors is not None:
        faces = faces.join(colors, "val")
    shown = [c for c in faces.columns if c in ("r", "g", "b", "a")]
    quad = ((F.col("z") * t.shape[1] + F.col("y")) * t.shape[0] + F.col("x")) * 6 + F.col("face")
    template = F.array(*(F.array(*(F.struct(*(F.lit(float(c[k])).alias("xyz"[k]) for k in range(3))) for c in _corners(axis, side))) for axis, side, _ in FACES))
    normals = F.array(*(F.struct(*(F.lit(float(side if k == axis else 0)).alias(f"n{'xyz'[k]}") for k in range(3))) for axis, side, _ in FACES))
    rows = faces.select(quad.alias("quad"), "x", "y", "z", "val", *shown, normals[F.col("face")].alias("n"), F.posexplode(template[F.col("face")]).alias("corner", "c"))
    vertices = rows.select("quad", "corner", *((F.col(a) + F.col(f"c.{a}")).alias(a) for a in "xyz"), "n.nx", "n.ny", "n.nz", "val", *shown)
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((0, 2, 1), (3, 2, 0))))
    triangles = faces.select(quad.alias("quad"), F.explode(sides).alias("t")).select("quad", "t.*")
    return vertices, triangles


def color_config(spark: SparkSession, colors: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """Values to colours, as a table; a value that isn't there is empty."""
    return spark.createDataFrame([(k, *v) for k, v in colors.items()], "val int, r int, g int, b int, a int")


def random_color_config(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Opaque colours for the values 1 to n."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("val"), *(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(256)).cast("int").alias(c) for k, c in enumerate("rgb")), F.lit(255).alias("a"))


def hue_colors(values: DataFrame, val: str = "val") -> DataFrame:
    """A hue for every value, at saturation 0.6 and lightness 0.5, by the golden ratio of the circle."""
    h = F.pmod(F.col(val) * 0.6180339887498949, F.lit(1.0)) * 6
    chroma, m = 0.6, 0.2
    second = chroma * (1 - F.abs(h % 2 - 1))
    k = F.floor(h)
    pick = lambda order: F.round((F.element_at(F.array(*order), (k + 1).cast("int")) + m) * 255).cast("int")
    c, s, o = F.lit(chroma), second, F.lit(0.0)
    return values.select(val, pick([c, s, o, o, s, c]).alias("r"), pick([s, c, c, s, o, o]).alias("g"), pick([o, o, s, c, c, s]).alias("b"), F.lit(255).alias("a"))


# Isosurfaces. A cube's corner k lies at (k & 1, k >> 1 & 1, k >> 2 & 1); an edge is (its lower corner, axis).
CORNERS = [(k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8)]


def _edge(a: int, b: int) -> tuple[int, int]:
    return min(a, b), {1: 0, 2: 1, 4: 2}[a ^ b]


def _face_rings() -> list[list[int]]:
    out = []
    for axis, side, _ in FACES:
        out.append([c[0] | c[1] << 1 | c[2] << 2 for c in _corners(axis, side)])
    return out


def case_triangles(case: int) -> list[tuple[tuple[int, int], ...]]:
    """Triangles of edges of a corner case. On every side of the cube the crossed edges are joined where the surface enters and
    leaves, filled corners kept apart on ambiguous sides; the joints close to rings, and a ring is fanned into triangles."""
    inside = [bool(case >> k & 1) for k in range(8)]
    follow: dict[tuple[int, int], tuple[int, int]] = {}
    for ring in _face_rings():
        turns = [(k, inside[ring[k]], inside[ring[(k + 1) % 4]]) for k in range(4)]
        enters = [k for k, a, b in turns if not a and b]
        leaves = [k for k, a, b in turns if a and not b]
        for k in enters:  # the filled stretch that begins here ends at the next leaving edge
            stop = min(leaves, key=lambda j: (j - k) % 4)
            follow[_edge(ring[stop], ring[(stop + 1) % 4])] = _edge(ring[k], ring[(k + 1) % 4])
    out = []
    while follow:
        first = min(follow)
        loop = [first]
        while (nxt := follow.pop(loop[-1])) != first:
            loop.append(nxt)
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return out


def corner_mask(t: StepTensor, density: float = 0.5) -> StepTensor:
    """Per cube of eight cells, the bits of the corners at or above the density: one pass of difference events."""
    kernel = np.zeros((2, 2, 2), np.int32)
    for k, (x, y, z) in enumerate(CORNERS):
        kernel[z, y, x] = 1 << k
    return conv(_indicator(t, lambda c: c >= density), kernel)


def marching_cubes(t: StepTensor, density: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z) where lattice edges cross the density, and triangles (a, b, c: vertex ids).

    A vertex id is three times its edge's lower cell plus the axis: no numbering pass.
    """
    spark, (w, h, _) = t.spark, t.shape
    steps = (1, w, w * h)
    parts = []
    for axis in range(3):
        lo = t[tuple(slice(0, n - (k == axis)) for k, n in enumerate(t.shape))]
        hi = t[tuple(slice(int(k == axis), n) for k, n in enumerate(t.shape))]
        crossed = map_values(lambda a, b: (a >= density) != (b >= density), lo, hi, kind="b")
        rows = walk(crossed, lo, hi)
        xyz = coordinates(F.col("pos"), lo.shape)
        share = (F.lit(density) - F.col("v0").cast("double")) / (F.col("v1").cast("double") - F.col("v0").cast("double"))
        cell = fold(lambda a, b: a + b, [c * s for c, s in zip(xyz, steps, strict=True)])
        parts.append(rows.select((cell * 3 + axis).alias("id"), *((c + share if k == axis else c).cast("double").alias("xyz"[k]) for k, c in enumerate(xyz))))
    vertices = fold(DataFrame.unionByName, parts)
    table = [(case, [[corner * 3 + axis for corner, axis in tri] for tri in case_triangles(case)]) for case in range(1, 255)]
    cases = spark.createDataFrame(table, "v0 int, tris array<array<int>>")
    mask = corner_mask(t, density)
    surface = map_values(lambda m: (m > 0) & (m < 255), mask, kind="b")
    rows = walk(surface, mask).join(F.broadcast(cases), "v0").select("pos", F.explode("tris").alias("tri"))  # 254 rows
    x, y, z = coordinates(F.col("pos"), mask.shape)
    base = x + y * steps[1] + z * steps[2]

    def vertex(k: int) -> Column:
        code = F.col("tri")[k].cast("bigint")
        corner = _div(code, 3)
        cell = base + corner % 2 + _div(corner, 2) % 2 * steps[1] + _div(corner, 4) * steps[2]
        return cell * 3 + code % 3

    return vertices, rows.select(*(vertex(k).alias("abc"[k]) for k in range(3)))


def isosurface(t: StepTensor, density: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Marching cubes over the mean of every 2 x 2 x 2 neighbourhood, padded by one."""
    return marching_cubes(conv(t.to("f"), np.full((2, 2, 2), 0.125, np.float32), 1).eval(), density)


def topdown(t: StepTensor, up: int = 1) -> DataFrame:
    """Per column along axis ``up`` (the third axes' coordinates a and b), the value of its highest filled cell."""
    a, b = (k for k in range(3) if k != up)
    rows = t.frame().where(scalar.nonzero(F.col("val"), t.kind)).select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "val")
    c = coordinates(F.col("pos"), t.shape)
    return rows.groupBy(c[a].alias("a"), c[b].alias("b")).agg(F.max_by("val", c[up]).alias("val"), F.max(c[up]).alias("height"))


def bounding_box(t: StepTensor) -> DataFrame:
    """One row: least and greatest coordinates of filled cells."""
    rows = red._rows(t).where(scalar.nonzero(F.col("val"), t.kind))
    y, z = F.col("row") % t.shape[1], _div(F.col("row"), t.shape[1])
    return rows.agg(F.min("x0").alias("x0"), (F.max("x1") - 1).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(z).alias("z0"), F.max(z).alias("z1"))


def column_orders(t: StepTensor) -> DataFrame:
    """Runs and run-compression ratio for each order of the axes."""
    parts = []
    for order in permutations(range(3)):
        moved = t if order == (0, 1, 2) else transpose(t, order)
        parts.append(red.statistics(moved).select(F.lit("".join("xyz"[k] for k in order)).alias("order"), F.col("runs").cast("bigint").alias("runs"), F.try_divide(F.col("cells").cast("double"), 2 * F.col("runs")).alias("ratio")))
    return fold(DataFrame.unionByName, parts)

