"""Embedding near-duplicates by dual traversal of cover trees, exact at a cosine threshold.

Vectors are compared inside their label. Equal vectors are one class first, so
that copies never meet each other. On unit vectors cosine >= c is a distance of
at most sqrt(2 - 2c).

The upper levels of the tree are tables: the root of a label and length is one
cell; a cell of more than BLOCK classes is dealt to the nearest of some of its own
members, picked by hash, one for each BLOCK and PIVOTS at most, whose cells are its children, until a cell fits a
block or all of it lies within reach, where hashing deals it into blocks. A cell
has its centre and covering radius (the largest distance from the centre). The
dual traversal goes down the same levels: from the pairs of roots a pair of cells
gives the pairs of their children, but those whose centres are farther apart than
both radii and the reach. The surviving pairs of blocks are one task's work each:
inside them a cover tree for either with nested levels of halving radii, and the
same traversal of node pairs. Leaf pairs are compared by cosine in double
precision. A pair of blocks returns the links' counts per vector and a spanning
forest of its links, not the links. Where vectors have no structure nothing can be
pruned, and an exact method compares all pairs of a label.

Edge cases: a null label, a null, empty or zero vector and one with a null or
non-finite component, or whose square overflows or vanishes, links with nothing and
is its own component; vectors of different lengths never link; rows equal in id,
label and vector count once; rows of one id with several vectors are one row with
the links of the vector that has most, in one component; a null id is a row that
links with nothing; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, components

BLOCK = 2048
#: Children of a cell, levels of cells at most, and vectors that one task deals to pivots.
PIVOTS, LEVELS, DEALT = 32, 16, 8192
LEAF = 48
#: Slack of pruning bounds against rounding; comparisons themselves have none.
SLACK = 1e-9


class CoverTree:
    """Nested levels: a node's children cover its points with half its radius, the first child has its own centre.

    Nodes are rows of arrays: the centre's point, the covering radius (the
    largest distance of a point below from the centre), and children or points.
    """

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        everyone = np.arange(len(unit))
        distance = self.distances(0, everyone)
        self.root = self.build(0, everyone, distance, 2.0)

    def distances(self, centre: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.unit[points] @ self.unit[centre])))

    def build(self, centre: int, points: np.ndarray, distance: np.ndarray, scale: float) -> int:
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.children.append([])
        self.points.append(points)
        half = scale / 2
        while half > 1e-3 and self.radius[node] <= half:  # levels on which the node is its own only child
            half /= 2
        if len(points) <= LEAF or half <= 1e-3:
            return node
        rest, at, parts, c = points, distance, [], centre
        while len(rest):
            near = at <= half
            near[rest == c] = True
            parts.append((c, rest[near], at[near]))
            rest = rest[~near]
            if len(rest):
                c = int(rest[0])
                at = self.distances(c, rest)
        if len(parts) > max(8, len(points) // 4):  # levels that hardly gather anything end the branch
            return node
        self.children[node] = [self.build(c, p, d, half) for c, p, d in parts]
        return node


def linked_pairs(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at or above the cosine, by dual traversal; with a is b each unordered pair once."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    norm_a, norm_b = np.sqrt((raw_a * raw_a).sum(1)), np.sqrt((raw_b * raw_b).sum(1))
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        cx, cy = a.unit[a.centre[x]], b.unit[b.centre[y]]
        if math.sqrt(max(0.0, 2.0 - 2.0 * float(cx @ cy))) - SLACK > a.radius[x] + b.radius[y] + reach:
            continue
        kx, ky = a.children[x], b.children[y]
        if a is b and x == y and kx:
            stack += [(kx[i], kx[j]) for i in range(len(kx)) for j in range(i, len(kx))]
        elif kx and (not ky or a.radius[x] >= b.radius[y]):
            stack += [(k, y) for k in kx]
        elif ky:
            stack += [(x, k) for k in ky]
        else:
            p, q = a.points[x], b.points[y]
            i, j = np.nonzero((raw_a[p] @ raw_b[q].T) / (norm_a[p][:, None] * norm_b[q][None, :]) >= cosine)
            i, j = p[i], q[j]
            if a is b and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as rows of a matrix."""
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


_FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def compare_blocks(left: pa.Table, right: pa.Table, same: bool, cosine: float) -> pa.Table:
    """Per class its links' summed copies (as `links`, where `other` is null) and spanning edges (node, other). Tables: node, copies, vector."""
    raw_a = _matrix(left["vector"])
    raw_b = raw_a if same else _matrix(right["vector"])
    a = CoverTree(raw_a / np.sqrt((raw_a * raw_a).sum(1))[:, None])
    b = a if same else CoverTree(raw_b / np.sqrt((raw_b * raw_b).sum(1))[:, None])
    n, m = len(raw_a), 0 if same else len(raw_b)
    ids, copies = (np.concatenate([t[name].to_numpy() for t in ([left] if same else [left, right])]) for name in ("node", "copies"))
    links, parent = np.zeros(n + m, np.int64), list(range(n + m))
    src, dst = [], []
    for i, j in linked_pairs(a, b, raw_a, raw_b, cosine):
        j = j if same else j + n
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            rx, ry = _find(parent, x), _find(parent, y)
            if rx != ry:
                parent[rx] = ry
                src.append(ids[x])
                dst.append(ids[y])
    some = np.flatnonzero(links)
    counts = pa.table({"node": pa.array(ids[some], pa.int64()), "other": pa.nulls(len(some), pa.int64()), "links": pa.array(links[some], pa.int64())}, schema=_FOUND)
    edges = pa.table({"node": pa.array(src, pa.int64()), "other": pa.array(dst, pa.int64()), "links": pa.array(np.zeros(len(src), np.int64))}, schema=_FOUND)
    return pa.concat_tables([counts, edges])


def _normal(vector: Column) -> tuple[Column, Column]:
    """Whether a vector can link, and its norm."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return fine & (square > 0) & (square < F.lit(float("inf"))), F.sqrt(square)


def _apart(a: Column, b: Column) -> Column:
    """The distance of two unit vectors; 0 where one is null, so that nothing is pruned."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)), F.lit(0.0))


def _dealt(big: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members of big cells with the nearest pivot's number `k` and the distance `away`: parts of a cell (cell, salt) meet their cell's pivots."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "away": pa.array([], pa.float64())})
        x = _matrix(left["vector"])
        x /= np.sqrt((x * x).sum(1))[:, None]
        order = np.argsort(right["k"].to_numpy())
        dot = x @ _matrix(right["centre"])[order].T
        k = dot.argmax(1)
        away = np.sqrt(np.maximum(0.0, 2 - 2 * dot[np.arange(len(k)), k]))
        return pa.table({"key": left["key"].combine_chunks().cast(pa.string()), "k": pa.array(k.astype(np.int32)), "away": pa.array(away)})

    salts = F.ceil(F.col("n") / DEALT).cast("int")
    left = big.select("cell", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), "key", "vector")
    right = pivots.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "k", "centre")
    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(nearest, "key string, k int, away double")


def _cells(work: Workspace, classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The classes with their last cell, and the pairs (x, y) of last cells that the traversal of the levels leaves, with how many blocks each is dealt into."""
    root = F.concat_ws("|", F.to_json(F.struct("label")), F.size("vector").cast("string"))
    placed = work.keep(classes.withColumn("cell", root), "placed-0")
    nowhere = F.lit(None).cast("array<double>")
    current = work.keep(placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.col("cell").alias("parent"), "n", nowhere.alias("centre"), F.lit(2.0).alias("radius")), "cells-0")
    pairs = work.keep(current.select(F.col("cell").alias("x"), F.col("cell").alias("y")), "pairs-0")
    level = 0
    while level < LEVELS:
        splits = current.where((F.col("n") > BLOCK) & (F.col("radius") > reach)).select("cell", "n")
        if splits.isEmpty():
            break
        level += 1
        big = placed.join(splits, "cell")
        # of some four times as many members by hash the first PIVOTS: a bounded number a cell
        some = big.where(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < 4.0 * PIVOTS / F.col("n"))
        norm = _normal(F.col("vector"))[1]
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("key", F.lit(level)), "key")) - 1
        pivots = work.keep(some.select("cell", "n", F.transform("vector", lambda x: x / norm).alias("centre"), place.alias("k")).where(F.col("k") < F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK))), f"pivots-{level}")
        near = work.keep(_dealt(big, pivots), f"dealt-{level}")
        moved = placed.join(near, "key", "left")
        child = F.when(F.col("k").isNotNull(), F.concat_ws("/", "cell", F.col("k").cast("string"))).otherwise(F.col("cell"))
        after = work.keep(moved.select("key", "node", "copies", "vector", child.alias("cell"), "away"), f"placed-{level}")
        grown = after.where("away IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        centres = pivots.select(F.concat_ws("/", "cell", F.col("k").cast("string")).alias("cell"), F.col("cell").alias("parent"), "centre")
        kept = current.join(splits.select("cell"), "cell", "left_anti").withColumn("parent", F.col("cell"))
        next_cells = work.keep(kept.select("cell", "parent", "n", "centre", "radius").unionByName(grown.join(centres, "cell").select("cell", "parent", "n", "centre", "radius")), f"cells-{level}")
        a = next_cells.select(F.col("cell").alias("a"), F.col("parent").alias("x"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        b = next_cells.select(F.col("cell").alias("b"), F.col("parent").alias("y"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        down = pairs.join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("a") <= F.col("b")))
        down = down.where(_apart(F.col("ca"), F.col("cb")) <= F.col("ra") + F.col("rb") + reach)
        pairs = work.keep(down.select(F.col("a").alias("x"), F.col("b").alias("y")), f"pairs-{level}")
        work.drop(f"placed-{level - 1}", f"cells-{level - 1}", f"pairs-{level - 1}", f"pivots-{level}", f"dealt-{level}")
        placed, current = after.drop("away"), next_cells
    parts = current.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    pairs = pairs.join(parts.select(F.col("cell").alias("x"), F.col("parts").alias("px")), "x").join(parts.select(F.col("cell").alias("y"), F.col("parts").alias("py")), "y")
    return placed.join(parts, "cell"), pairs


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).distinct()
    valid, norm = _normal(F.col("vector"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid)
    # classes of equal vectors; a class is named by its least id, unique to it unless an id has several vectors, which then count as one
    members = work.keep(good.withColumn("key", F.sha2(F.to_json(F.struct("label", "vector")), 256)), "members")
    classes = work.keep(members.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")), "classes")
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    placed, pairs = _cells(work, classes, reach)
    sides = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("px") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("py") - 1)))
    sides = sides.where((F.col("x") != F.col("y")) | (F.col("i") <= F.col("j"))).withColumn("same", (F.col("x") == F.col("y")) & (F.col("i") == F.col("j")))
    sides = sides.withColumn("pair", F.concat_ws(" ", "x", F.col("i").cast("string"), "y", F.col("j").cast("string")))
    roles = sides.select("pair", "same", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("cell"), F.col("i").alias("part")), F.struct(F.lit(1).alias("side"), F.col("y").alias("cell"), F.col("j").alias("part")))).alias("r"))
    roles = work.keep(roles.where(~F.col("same") | (F.col("r.side") == 0)).select("pair", "same", "r.side", "r.cell", "r.part"), "roles")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    work_rows = dealt.join(roles, ["cell", "part"]).select("pair", "side", "same", "node", "copies", "vector")

    def compare(block: pa.Table) -> pa.Table:
        if block["same"][0].as_py():
            return compare_blocks(block, block, True, cosine)
        side = block["side"].to_numpy()
        left, right = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        return compare_blocks(left, right, False, cosine)

    found = work.keep(work_rows.groupBy("pair").applyInArrow(compare, "node long, other long, links long"), "found")
    work.drop("roles")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(work, found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = classes.select("key", "node", "copies").join(links, "node", "left").join(groups, "node", "left")
    linked = members.select("vec_id", "key").join(named, "key").groupBy("vec_id").agg(F.max(F.coalesce(F.col("links"), F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component_id"))
    alone = rows.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(valid, F.lit(False))))
    rest = alone.select("vec_id").distinct().join(linked.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", F.col("n_links").cast("long"), "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
