"""Near-duplicate vectors by PCA-ordered tiles.

Vectors are turned to the principal axes of the whole table's second moments.  Sorted by
label and first axis they are cut into tiles; two tiles meet only if their intervals on
the first axis are near enough for a link.  Inside a pair of tiles the leading dimensions
are multiplied first; a pair of vectors goes on only while its partial product plus the
product of the two suffix norms can still reach the threshold, and a pair of tiles stops
when none can.  Survivors get their cosine in double precision from the vectors as given.

Equal vectors of a label are one class with a count, so copies are never compared; a pair
of tiles returns link counts and, for each vector, one link towards the smallest vector it
hangs together with there, never all pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components,
or a null label, links with nothing; vectors of different lengths never link; a null
vec_id is a vector like any other and orders before all ids; repeated rows are separate
vectors; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .token_store import _arrow

THRESHOLD, TILE, STEP = 0.93, 1024, 16
TILES = "label int, dim int, tile string, low double, high double, nodes array<binary>"
NODE = "struct<id:bigint,h1:bigint,h2:bigint>"
SLACK = 1e-9  # of the rotated products; survivors are computed again without rotation


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a class key, and one row for each class that can link."""
    sound = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", F.lit(1), "label")})
    rows = scratch.save(rows, "vector-rows")
    some = rows.where("sound").groupBy("h1", "h2")
    classes = some.agg(
        F.min(F.coalesce("vec_id", F.lit(-(1 << 63)))).alias("id"), F.count("*").alias("copies"),
        F.first("label").cast("int").alias("label"), F.first("embedding").alias("embedding"),
    )
    return rows, scratch.save(classes.withColumn("dim", F.size("embedding")), "vector-classes")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes of the second moments of all unit vectors."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims):
                x = _matrix(b.column("embedding").filter(pa.array(dims == d)))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array(np.full(d * d, d), pa.int32()), "at": pa.array(np.arange(d * d)), "s": pa.array(s.reshape(-1))}
            )

    sums = classes.select("dim", "embedding").mapInArrow(moments, "dim int, at long, s double")
    total = sums.groupBy("dim", "at").agg(F.sum("s").alias("s")).collect()  # as many rows as a matrix has cells
    axes: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in total}:
        m = np.zeros(d * d)
        for r in total:
            if r["dim"] == d:
                m[r["at"]] = r["s"]
        axes[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into x, into y) with cosine >= threshold; i < j if both are one tile."""
    p, q = _unit(x) @ axes, _unit(y) @ axes
    rows, cols = np.arange(len(p)), np.arange(len(q))
    done = np.zeros((len(p), len(q)))
    for at in range(0, p.shape[1], STEP):
        done += p[rows, at : at + STEP] @ q[cols, at : at + STEP].T
        rest_p = np.linalg.norm(p[rows, at + STEP :], axis=1)
        rest_q = np.linalg.norm(q[cols, at + STEP :], axis=1)
        alive = done + rest_p[:, None] * rest_q[None, :] >= threshold - SLACK
        if same:
            alive &= rows[:, None] < cols[None, :]
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not r.any():
            return np.zeros(0, int), np.zeros(0, int)
        rows, cols, done, alive = rows[r], cols[c], done[np.ix_(r, c)], alive[np.ix_(r, c)]
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    keep = np.zeros(len(i), bool)
    lx, ly = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep[at : at + (1 << 15)] = np.einsum("ij,ij->i", x[a], y[b]) / (lx[a] * ly[b]) >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes, the node of least rank it is joined to by the pairs."""
    best = rank.copy()
    while True:
        low = np.minimum(best[i], best[j])
        new = best.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == best).all():
            return np.argsort(rank)[best]
        best = new


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """Written tiles: consecutive vectors of one label along the first axis."""

    def first_axis(batches):
        for b in batches:
            dims, out = np.asarray(b.column("dim")), np.zeros(len(b))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = _unit(_matrix(b.column("embedding").take(pa.array(at)))) @ axes[d][:, 0]
            yield b.append_column("place", pa.array(out))

    kind = "h1 long, h2 long, id long, copies long, label int, embedding array<double>, dim int, place double"
    placed = classes.select("h1", "h2", "id", "copies", "label", "embedding", "dim").mapInArrow(first_axis, kind)
    placed = scratch.save(placed, "vector-places")
    keys = ["label", "dim", "place", "id", "h1", "h2"]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def cut(batches):
        from pyspark import TaskContext

        part, serial, held = TaskContext.get().partitionId(), 0, []

        def emit():
            nonlocal serial, held
            t = pa.Table.from_batches(held).combine_chunks()
            held, serial = [], serial + 1
            blobs = [
                np.asarray(t.column(c)).astype("<i8").tobytes() for c in ("id", "h1", "h2", "copies")
            ] + [_matrix(t.column("embedding").combine_chunks()).astype("<f8").tobytes()]
            place = np.asarray(t.column("place"))
            row = {
                "label": t.column("label")[0].as_py(), "dim": t.column("dim")[0].as_py(),
                "tile": f"{part}-{serial}", "low": place[0], "high": place[-1], "nodes": blobs,
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow(TILES))

        for b in batches:
            key = np.stack([np.asarray(b.column("label")), np.asarray(b.column("dim"))])
            at = 0
            while at < len(b):
                if held and (key[0, at], key[1, at]) != (held[-1].column("label")[0].as_py(), held[-1].column("dim")[0].as_py()):
                    yield emit()
                change = np.flatnonzero((key[:, at:] != key[:, at : at + 1]).any(axis=0))
                run = int(change[0]) if len(change) else len(b) - at
                run = min(run, tile - sum(len(h) for h in held))
                held.append(b.slice(at, run))
                at += run
                if sum(len(h) for h in held) == tile:
                    yield emit()
        if held:
            yield emit()

    return scratch.save(placed.mapInArrow(cut, TILES), "vector-tiles")


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows, classes = _classes(vectors)
    axes = principal_axes(classes)
    tiles = _tiles(classes, axes, tile)

    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK  # links are no further apart on any axis
    facts = tiles.select("label", "dim", "tile", "low", "high")
    far = F.sequence(F.floor(F.col("low") / reach), F.floor((F.col("high") + reach) / reach))
    left = facts.select("label", "dim", F.col("tile").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode(far).alias("cell"))
    right = facts.select("label", "dim", F.col("tile").alias("b"), F.col("low").alias("b_low"), F.floor(F.col("low") / reach).alias("cell"))
    near = (F.struct("b_low", "b") >= F.struct("a_low", "a")) & (F.col("b_low") <= F.col("a_high") + reach)
    pairs = left.join(right, ["label", "dim", "cell"]).where(near).select("dim", "a", "b")
    pairs = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("nodes").alias("a_nodes")), "a")
    pairs = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("nodes").alias("b_nodes")), "b")

    found_type = "id long, h1 long, h2 long, links long, root_id long, root_h1 long, root_h2 long"

    def compare(batches):
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1).to_pylist()[0]
                d, same = row["dim"], row["a"] == row["b"]
                (xi, x), (yi, y) = (
                    (np.stack([np.frombuffer(k, "<i8") for k in n[:4]]), np.frombuffer(n[4], "<f8").reshape(-1, d))
                    for n in (row["a_nodes"], row["b_nodes"])
                )
                i, j = linked(x, y, axes[d], threshold, same)
                if not len(i):
                    continue
                nodes = xi if same else np.concatenate([xi, yi], axis=1)
                jj = j if same else j + len(x)
                links = np.zeros(nodes.shape[1], np.int64)
                np.add.at(links, i, nodes[3, jj])
                np.add.at(links, jj, nodes[3, i])
                rank = np.empty(nodes.shape[1], np.int64)
                rank[np.lexsort((nodes[2], nodes[1], nodes[0]))] = np.arange(nodes.shape[1])
                root = _roots(nodes.shape[1], i, jj, rank)
                at = np.flatnonzero(links)
                columns = [nodes[0, at], nodes[1, at], nodes[2, at], links[at], *(nodes[k, root[at]] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_arrow(found_type))

    found = scratch.save(pairs.mapInArrow(compare, found_type), "vector-links")
    node = F.struct("id", "h1", "h2").alias("a")
    root = F.struct(F.col("root_id").alias("id"), F.col("root_h1").alias("h1"), F.col("root_h2").alias("h2")).alias("b")
    roots = components(found.select(node, root)).select("node.h1", "node.h2", F.col("root.id").alias("root"))
    totals = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    facts = classes.select("h1", "h2", "id", "copies").join(totals, ["h1", "h2"], "left").join(roots, ["h1", "h2"], "left")
    facts = facts.select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")
    )
    facts = scratch.save(facts, "vector-facts")
    out = rows.where("sound").select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "root")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root"))
    component = F.when(F.col("root") != -(1 << 63), F.col("root"))
    return out.unionByName(alone).select(
        "vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
