"""Hard-negative mining with cover trees over norm-augmented candidates.

A candidate p of a block becomes (p, sqrt(M^2 - |p|^2)), M being the block's largest norm, and an
anchor q becomes (q, 0): all candidates lie on one sphere, inner products stay as they were, and
an inner product is |q| M times the cosine of an angle. A block's candidates form a cover tree: a
node's children are a net of half its covering angle, kept apart by that angle, and a point far
from all others hangs on the node itself. A node whose centre is at angle t from the anchor and
whose points are within r of the centre holds inner products between |q| M cos(t + r) and
|q| M cos(t - r) only. Nodes are opened best first; one that lies outside all windows of scores
asked for, cannot enter the best found so far, or has no label that counts is skipped. What
hangs on an opened node is verified with exact integer products.

Blocks lie within cells around pivots, so anchors go only to cells that can matter. Rows of one
vector and label are one candidate, with as many of its ids as can ever be returned.
"""

from __future__ import annotations

import io
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.llm.common import pick
from inkloom.session import cut_lineage

#: Candidates of a block, anchors of a unit of work, points that are not split further.
BLOCK = 4096
ANCHORS = 4096
LEAF = 32
#: Pivots come from a sample of this many candidates at most, so there are at most MOST_CELLS;
#: every candidate then goes to its nearest pivot, and a cell has as many blocks as it needs.
SAMPLE = 2048
MOST_CELLS = 256
LONG = (1 << 63) - 1
#: Slack for angles computed in floating point, as a share of |q| M and absolute.
SLACK, LEAST = 1e-6, 1.0


def padded(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of one integer matrix; missing components are zero."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, vector in enumerate(vectors):
        part = vector[:width]
        out[k, : len(part)] = part
    return out


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, in long's range: beyond it, the nearest long."""
    longest = np.sqrt((points.astype(float) ** 2).sum(axis=1).max(initial=0))
    if longest * np.sqrt((query.astype(float) ** 2).sum()) < 1 << 52:
        # No partial sum leaves the whole numbers that a double holds.
        return (points.astype(float) @ query.astype(float)).astype(np.int64)
    exact = points.astype(object) @ query.astype(object)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in exact], np.int64)


class CoverTree:
    """Cover tree of a block: points in the order of the nodes they hang on, nodes in arrays."""

    FIELDS = ("points", "label", "id", "id_from", "center", "angle", "low", "high", "child", "loose", "norm")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.as_float = self.points.astype(float)
        self.center_float = self.as_float[self.center]
        self.top = float(self.norm[0])

    @classmethod
    def build(cls, vectors: np.ndarray, label: np.ndarray, ids: list[list[int]]) -> CoverTree:
        as_float = vectors.astype(float)
        squares = (as_float**2).sum(axis=1)
        top = float(np.sqrt(squares.max()))
        lifted = np.column_stack([as_float, np.sqrt(np.maximum(0, top * top - squares))])
        lifted /= top or 1.0

        def angles(who: np.ndarray, center: int) -> np.ndarray:
            return np.arccos(np.clip(lifted[who] @ lifted[center], -1, 1))

        first = np.arange(len(vectors))
        around = angles(first, 0)
        todo = [(first, 0, around, 0)]
        center, angle, low, high, loose = [0], [float(around.max())], [0], [0], [first[:0]]
        children: list[list[int]] = [[]]
        for members, c, near, node in todo:
            low[node], high[node] = label[members].min(), label[members].max()
            if len(members) <= LEAF or angle[node] < 1e-6:
                loose[node] = members
                continue
            # A net by farthest points: centres further apart than the target, all covered by it.
            target, near, owner, net = angle[node] / 2, near.copy(), np.zeros(len(members), int), [c]
            while near[far := int(near.argmax())] > target:
                other = angles(members, int(members[far]))
                closer = other < near
                closer[far] = True
                near[closer], owner[closer] = other[closer], len(net)
                near[far] = 0.0
                net.append(int(members[far]))
            sizes = np.bincount(owner, minlength=len(net))
            loose[node] = members[sizes[owner] == 1]
            for k in np.flatnonzero(sizes > 1).tolist():
                own = owner == k
                children[node].append(len(center))
                todo.append((members[own], net[k], near[own], len(center)))
                for column, value in ((center, net[k]), (angle, float(near[own].max())), (low, 0), (high, 0)):
                    column.append(value)
                loose.append(first[:0])
                children.append([])
        order = np.concatenate(loose)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # Children of a node are numbered one after another.
        child = [(c[0], c[-1] + 1) if c else (0, 0) for c in children]
        return cls(
            points=vectors[order],
            label=label[order],
            id=np.array([i for k in order.tolist() for i in ids[k]], np.int64).reshape(-1, 2),
            id_from=np.cumsum([0, *[len(ids[k]) for k in order.tolist()]]),
            center=place[np.array(center)],
            angle=np.array(angle),
            low=np.array(low),
            high=np.array(high),
            child=np.array(child),
            loose=np.cumsum([0, *map(len, loose)]),
            norm=np.array([top]),
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{name: arrays[name] for name in cls.FIELDS})

    def bounds(self, nodes: np.ndarray, query: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each node can hold."""
        apart = np.arccos(np.clip(self.center_float[nodes] @ query / (reach or 1.0), -1, 1))
        slack = SLACK * reach + LEAST
        upper = reach * np.cos(np.maximum(apart - self.angle[nodes], 0)) + slack
        lower = reach * np.cos(np.minimum(apart + self.angle[nodes], np.pi)) - slack
        return lower, upper

    def search(
        self,
        vector: np.ndarray,
        label: int,
        windows: list[tuple[int, int]],
        count: int,
        same: bool,
        own: tuple[int, int] | None = None,
    ) -> list[list[tuple[int, tuple[int, int]]]]:
        """For each window (lowest, highest score) its first ``count`` (score, id): higher scores
        first, ties by id. ``same`` asks for rows of the label, else for rows of any other.
        ``own`` is the id of the anchor, left out once among rows of its vector and label."""
        width = self.points.shape[1]
        query = np.zeros(width, np.int64)
        query[: min(width, len(vector))] = vector[:width]
        beyond = any(vector[width:])
        as_float = query.astype(float)
        reach = float(np.sqrt((as_float**2).sum())) * self.top
        whole = reach < 1 << 52
        best: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in windows]
        floor = np.array([w[0] for w in windows], float)
        ceiling = np.array([w[1] for w in windows], float)

        def wanted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lower, upper = self.bounds(nodes, as_float, reach)
            inside = (upper[:, None] >= floor) & (lower[:, None] <= ceiling)
            labels = (
                (self.low[nodes] <= label) & (label <= self.high[nodes])
                if same
                else (self.low[nodes] != label) | (self.high[nodes] != label)
            )
            return inside.any(axis=1) & labels, upper

        keep, upper = wanted(np.arange(1))
        heap = [(-upper[0], 0)] if keep[0] else []
        while heap:
            bound, node = heappop(heap)
            if not (-bound >= floor).any():
                break
            a, b = self.loose[node], self.loose[node + 1]
            if a < b:
                score = (
                    (self.as_float[a:b] @ as_float).astype(np.int64)
                    if whole
                    else products(self.points[a:b], query)
                )
                fits = (self.label[a:b] == label) == same
                for w, (low, high) in enumerate(windows):
                    least = max(low, best[w][-1][0]) if len(best[w]) == count else low
                    found = np.flatnonzero(fits & (score >= least) & (score <= high))
                    if not len(found):
                        continue
                    start = self.id_from[a + found]
                    # More groups than are asked for, as the anchor's own may lose its id.
                    first = np.lexsort((self.id[start, 1], self.id[start, 0], -score[found]))[: count + 1]
                    for k in (a + found[first]).tolist():
                        names = [tuple(x) for x in self.id[self.id_from[k] : self.id_from[k + 1]].tolist()]
                        if same and own in names and not beyond and (self.points[k] == query).all():
                            names.remove(own)
                        best[w] += [(int(score[k - a]), name) for name in names]
                    best[w].sort(key=lambda x: (-x[0], x[1]))
                    del best[w][count:]
                    if len(best[w]) == count:
                        floor[w] = max(low, best[w][-1][0])
            a, b = self.child[node]
            if a < b:
                nodes = np.arange(a, b)
                keep, upper = wanted(nodes)
                for k in np.flatnonzero(keep).tolist():
                    heappush(heap, (-upper[k], int(nodes[k])))
        return best


# -- Spark -------------------------------------------------------------------------------------


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector, label) of the rows that take part, components as whole numbers."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return rows.filter(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    ).select("vec_id", whole.alias("vector"), "label")


def candidates(rows: DataFrame, ids: int) -> DataFrame:
    """(vector, label, ids) of each distinct vector and label: its first ``ids`` ids as
    (1 if null else 0, id), which is their order."""
    name = F.struct(
        F.col("vec_id").isNull().cast("bigint").alias("missing"),
        F.coalesce("vec_id", F.lit(0).cast("bigint")).alias("id"),
    )
    # The limit applies before the shuffle too, so that a very common vector meets as few rows.
    order = Window.partitionBy("vector", "label").orderBy("name")
    named = rows.select("vector", "label", name.alias("name"))
    first = named.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ids)
    return first.groupBy("vector", "label").agg(F.sort_array(F.collect_list("name")).alias("ids"))


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    """A net of the sample by farthest points, one pivot for each cell."""
    sample = points.select("vector").orderBy(F.xxhash64("vector", "label")).limit(SAMPLE).collect()
    vectors = [r.vector for r in sample]
    dots = padded(vectors, max(map(len, vectors), default=0)).astype(float)
    chosen, near = [0], ((dots - dots[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(dots)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((dots - dots[chosen[-1]]) ** 2).sum(axis=1))
    return dots[chosen]


def _to_cells(pivots: np.ndarray):
    """Arrow function vector -> (cell, distance to its pivot)."""

    @F.arrow_udf("cell int, away double")
    def nearest(vectors: pa.Array) -> pa.Array:
        own = vectors.to_pylist()
        width = max(pivots.shape[1], max(map(len, own), default=0))
        points = padded(own, width).astype(float)
        centers = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
        cell = ((centers**2).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)
        away = np.sqrt(((points - centers[cell]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(away)], names=["cell", "away"]
        )

    return nearest


def _build(table: pa.Table) -> pa.Table:
    vectors = table["vector"].to_pylist()
    tree = CoverTree.build(
        padded(vectors, max(map(len, vectors))),
        table["label"].to_numpy(),
        [[(x["missing"], x["id"]) for x in ids] for ids in table["ids"].to_pylist()],
    )
    return pa.table(
        {
            "cell": table["cell"][:1],
            "part": table["part"][:1],
            "tree": pa.array([tree.dump()], pa.binary()),
        }
    )


class Index:
    """Cover trees of all candidates in the shared folder, and what is known of each cell."""

    def __init__(self, points: DataFrame):
        self.points = cut_lineage(points)
        spark = points.sparkSession
        count = self.points.count()
        self.trees = spark.createDataFrame([], "cell int, part int, tree binary")
        self.cells: dict[str, np.ndarray] = {}
        if not count:
            return
        pivots = _pivots(self.points, min(MOST_CELLS, -(-count // BLOCK)))
        placed = cut_lineage(self.points.withColumn("at", _to_cells(pivots)("vector")).select("*", "at.*"))
        # At most MOST_CELLS rows.
        known = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.max("away").alias("away"),
            F.min("label").alias("low"), F.max("label").alias("high"),
        ).collect()
        cell = np.array([r.cell for r in known])
        self.cells = {"cell": cell, "center": pivots[cell]} | {
            name: np.array([r[name] for r in known]) for name in ("away", "low", "high")
        }
        self.parts = {int(r.cell): -(-r["rows"] // BLOCK) for r in known}
        parts = F.create_map(*[F.lit(x) for pair in self.parts.items() for x in pair])[F.col("cell")]
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("vector", "label"), parts).cast("int"))
        self.trees = cut_lineage(
            dealt.select("cell", "part", "vector", "label", "ids")
            .groupBy("cell", "part")
            .applyInArrow(_build, self.trees.schema)
        )

    def search(self, queries: DataFrame, count: int, same: bool, percent: int | None) -> DataFrame:
        """(anchor, high, score, name) of (anchor, vec_id, vector, label, tops) rows.

        ``tops`` are the highest scores of the windows asked for; a window's lowest is
        ``percent`` of it (None: no lowest). Each block gives its own first ``count``.
        """
        if not self.cells:
            none = "anchor bigint, high bigint, score bigint, name struct<missing: bigint, id: bigint>"
            return queries.sparkSession.createDataFrame([], none)
        turns = max(1, -(-queries.count() // ANCHORS))
        to_cells = queries.select("*", F.explode(_routes(self.cells, same, percent)("vector", "label", "tops")).alias("cell"))
        parts = F.create_map(*[F.lit(x) for pair in self.parts.items() for x in pair])[F.col("cell")]
        asked = to_cells.select(
            "*",
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            F.pmod(F.xxhash64("anchor"), F.lit(turns)).cast("int").alias("turn"),
        )
        copies = self.trees.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        key = ["cell", "part", "turn"]

        def look(key, right: pa.Table, left: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(right) and len(left):
                tree = CoverTree.load(right["tree"][0].as_py())
                for row in left.to_pylist():
                    windows = [(lowest(top, percent), top) for top in row["tops"]]
                    own = (0, row["vec_id"]) if row["vec_id"] is not None else (1, 0)
                    vector = np.array(row["vector"], np.int64)
                    found = tree.search(vector, row["label"], windows, count, same, own if same else None)
                    out += [
                        (row["anchor"], top, score, *name)
                        for top, best in zip(row["tops"], found, strict=True)
                        for score, name in best
                    ]
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            name = pa.StructArray.from_arrays(columns[3:], names=["missing", "id"])
            return pa.table([*columns[:3], name], names=["anchor", "high", "score", "name"])

        return (
            copies.groupBy(*key)
            .cogroup(asked.groupBy(*key))
            .applyInArrow(look, "anchor bigint, high bigint, score bigint, name struct<missing: bigint, id: bigint>")
        )


def lowest(top: int, percent: int | None) -> int:
    """The least whole score s with percent * top <= 100 * s."""
    return -LONG - 1 if percent is None else -(-percent * top // 100)


def _routes(cells: dict[str, np.ndarray], same: bool, percent: int | None):
    """Arrow function (vector, label, tops) -> the cells that can hold what is asked for."""

    @F.arrow_udf("array<int>")
    def routes(vectors: pa.Array, labels: pa.Array, tops: pa.Array) -> pa.Array:
        out = []
        for vector, label, top in zip(vectors.to_pylist(), labels.to_pylist(), tops.to_pylist(), strict=True):
            query = np.array(vector, float)
            long = np.sqrt((query**2).sum())
            width = min(len(query), cells["center"].shape[1])
            middle = cells["center"][:, :width] @ query[:width]
            reach = long * cells["away"] + SLACK * (np.abs(middle) + long * cells["away"]) + LEAST
            keep = np.zeros(len(middle), bool)
            for high in top:
                keep |= (middle - reach <= high) & (middle + reach >= lowest(high, percent))
            if same:
                keep &= (cells["low"] <= label) & (label <= cells["high"])
            else:
                keep &= (cells["low"] != label) | (cells["high"] != label)
            out.append(cells["cell"][keep].tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return routes


def _first(found: DataFrame, keys: list[str], count: int, out: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "name")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= count)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label; ``anchor`` is a condition on vec_id, null being
    false. Components become floor(scale * x); a component or score beyond a long counts as the
    nearest long, and shorter vectors as filled up with zeros. Rows with a null label, a null
    vector or a component that is null or not finite take no part. A null vec_id is returned as
    null and comes last among ties. Every row is a row of its own: rows that repeat an id, a
    vector or both are returned as often as they stand there, anchors too. A positive without
    such negatives gives no rows, as does an empty table; other columns are not looked at.
    """
    rows = pick(rows, vec_id="bigint", embedding="array<double>", label="bigint")
    index = Index(candidates(usable(rows, scale), max(positives + 1, negatives)))
    # Anchors as distinct (vec_id, vector, label), numbered; the numbers are written with them.
    asked = (
        usable(rows.filter(anchor), scale)
        .groupBy("vec_id", "vector", "label")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("anchor", F.monotonically_increasing_id())
    )
    asked = cut_lineage(asked)
    everything = F.array(F.lit(LONG).cast("bigint")).alias("tops")
    near = index.search(asked.select("anchor", "vec_id", "vector", "label", everything), positives, True, None)
    kept = cut_lineage(_first(near.select("anchor", "score", "name"), ["anchor"], positives, "nth"))
    tops = kept.groupBy("anchor").agg(F.collect_set("score").alias("tops"))
    windows = asked.join(tops, "anchor").select("anchor", "vec_id", "vector", "label", "tops")
    found = _first(index.search(windows, negatives, False, percent), ["anchor", "high"], negatives, "rank")
    chosen = kept.select(
        "anchor", "nth", F.col("score").alias("positive_score"), F.col("name").alias("positive")
    )
    joined = (
        asked.select("anchor", F.col("vec_id").alias("anchor_id"), "copies")
        .join(chosen, "anchor")
        .join(found.withColumnRenamed("high", "positive_score"), ["anchor", "positive_score"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    )

    def named(column: str) -> Column:
        return F.when(F.col(column)["missing"] == 0, F.col(column)["id"])

    return joined.select(
        "anchor_id", named("positive").alias("positive_id"), "rank", named("name").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
