"""Exact top-k by inner product: best-first search of an M-tree in tables.

Inner products become distances by one more coordinate: with M the largest norm
and x' = (x, sqrt(M^2 - |x|^2)), q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so
nearest is highest.

The tree is built from the top, one Spark pass a level: a node of more than
``page_rows`` vectors gets up to ``fanout`` routing objects out of a bounded
sample of its own, and each of its vectors goes to the nearest.  A routing
object is stored with its covering radius and its distance to the node's own
routing object, a vector with its distance to the routing object of its leaf.
Inner nodes are rows of one table a level, leaves are pages of a table.

Queries go down in blocks, a level a join.  A first descent follows the most
promising children until they hold enough vectors, which bounds the k-th score;
the second visits each node that can still beat that bound.  On both ways the
stored parent distances rule out routing objects and vectors before anything is
computed for them.  All bounds come from the triangle inequality and are
loosened by a rounding margin, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

SLACK = 1e-6
SLAB_ROWS = 8192
MAX_LEVELS = 12


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component; rows with a null vector or
    a null or non-finite component are left out."""
    x = F.col(vector)
    wide = F.transform(x, lambda e: e.cast("double"))
    whole = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(F.coalesce(e, F.lit(0.0))) & (F.abs(e.cast("double")) < float("inf"))
    )
    return rows.where(x.isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(wide, lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("vector"),
    )


class Tree(NamedTuple):
    """inner[level]: node, slots, centres, ups, radii, counts of its children;
    pages: node, salt, n, ids, parents, data of the leaves."""

    dims: int
    largest: float  # M^2
    root: np.ndarray  # the root's routing object, lifted
    inner: list[DataFrame]
    pages: DataFrame


def _matrix(lists: list[list[int]], dims: int) -> np.ndarray:
    """Rows padded with zeros; float64 holds their products exactly up to 2^53."""
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(0.0, largest - np.einsum("ij,ij->i", x, x))
    return np.hstack([x, np.sqrt(rest)[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


POINT = "row long, vec_id long, node long, parent double, data binary"
INNER = "node long, slots binary, centres binary, ups binary, radii binary, counts binary"
PAGE = "node long, salt int, n int, ids binary, parents binary, data binary"


def spread_out(sample: np.ndarray, fanout: int) -> list[int]:
    """Routing objects: the row farthest from those chosen so far, again and again."""
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < fanout and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return chosen


def _choose(dims: int, largest: float, fanout: int):
    """Sampled vectors of a node -> its routing objects, far from each other so that
    covering radii are small; the first is the nearest to the node's own."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("data").sort_values(["parent", "data"], kind="stable")
        x = lift(np.frombuffer(b"".join(frame["data"]), "<i8").reshape(len(frame), dims).astype(float), largest)
        chosen = spread_out(x, fanout)
        return pd.DataFrame(
            {
                "node": frame["node"].iloc[:1].to_numpy(), "centres": [x[chosen].astype("<f8").tobytes()],
                "ups": [frame["parent"].to_numpy("<f8")[chosen].tobytes()], "children": [len(chosen)],
            }
        )

    return choose


def _assign(dims: int, largest: float, fanout: int):
    def assign(rows: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["data"]), "<i8").reshape(len(rows), dims).astype(float)
        d = distances(lift(x, largest), np.frombuffer(routes["centres"].iloc[0], "<f8").reshape(-1, dims + 1))
        near = d.argmin(axis=1)
        out = rows[["row", "vec_id", "node", "parent", "data"]].copy()
        out["node"] = rows["node"].to_numpy() * fanout + near + 1
        out["parent"] = d[np.arange(len(near)), near]
        return out

    return assign


def _inner_row(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("child")
    first = frame.iloc[0]
    slots = frame["slot"].to_numpy()
    centres = np.frombuffer(first["centres"], "<f8").reshape(first["children"], -1)[slots]
    return pd.DataFrame(
        {
            "node": [first["node"]], "slots": [frame["child"].to_numpy("<i8").tobytes()], "centres": [centres.tobytes()],
            "ups": [np.frombuffer(first["ups"], "<f8")[slots].tobytes()],
            "radii": [frame["radius"].to_numpy("<f8").tobytes()], "counts": [frame["n"].to_numpy("<i8").tobytes()],
        }
    )


def _page(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", kind="stable")
    return pd.DataFrame(
        {
            "node": frame["node"].iloc[:1].to_numpy(), "salt": frame["salt"].iloc[:1].to_numpy(), "n": [len(frame)],
            "ids": [frame["vec_id"].to_numpy("<i8").tobytes()],
            "parents": [frame["parent"].to_numpy("<f8").tobytes()], "data": [b"".join(frame["data"])],
        }
    )


def build(vectors: DataFrame, fanout: int, page_rows: int, sample_rows: int) -> Tree | None:
    """The tree over all ``vectors``; None where there are none.

    Only routing objects come from samples (about ``sample_rows`` rows of each
    node by a hash of the stored row number); every vector is indexed.  A node
    that cannot be split, such as one of equal vectors, or one below
    ``MAX_LEVELS``, becomes a leaf of several pages.
    """
    square = F.aggregate(
        "vector", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")
    )
    facts = vectors.agg(F.max(F.size("vector")).alias("dims"), F.max(square).alias("largest")).first()
    if facts["dims"] is None:
        return None
    dims, largest = max(1, facts["dims"]), float(facts["largest"])
    if largest >= 2**53:
        raise ValueError("components too large: a squared norm must stay below 2^53")
    top = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(1).collect()
    root = lift(_matrix([r["vector"] for r in top], dims), largest)[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), dims)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(distances(lift(x, largest), root[None, :])[:, 0]),
                    pa.array([row.tobytes() for row in x.astype("<i8")], pa.binary()),
                ],
                names=["vec_id", "parent", "data"],
            )

    # the row numbers are stored before they are used: a task that runs again reads the same ones
    points = materialize(
        vectors.mapInArrow(place, "vec_id long, parent double, data binary").select(
            F.monotonically_increasing_id().alias("row"), "vec_id", F.lit(0).cast("long").alias("node"), "parent", "data"
        ),
        "tree-rows",
    )
    leaves, inner = [], []
    sizes = points.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("radius"))
    while True:
        big = sizes.where(F.col("n") > page_rows).select("node", "n")
        if len(inner) == MAX_LEVELS or big.isEmpty():
            leaves.append(points)
            break
        sampled = points.join(big, "node").where(F.pmod(F.xxhash64("row", F.lit(len(inner))), F.col("n")) < sample_rows)
        routes = materialize(
            sampled.select("node", "parent", "data")
            .groupBy("node")
            .applyInPandas(_choose(dims, largest, fanout), "node long, centres binary, ups binary, children int")
            .where("children > 1")
            .join(big, "node")
            .withColumn("salts", F.ceil(F.col("n") / SLAB_ROWS)),
            "tree-routes",
        )
        if routes.isEmpty():
            leaves.append(points)
            break
        moving = points.join(routes.select("node", "salts"), "node").withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
        slabs = routes.select("node", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        moved = materialize(
            moving.groupBy("node", "salt").cogroup(slabs.groupBy("node", "salt")).applyInPandas(_assign(dims, largest, fanout), POINT),
            "tree-level",
        )
        sizes = materialize(
            moved.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("radius")), "tree-sizes"
        )
        children = sizes.select(
            F.floor((F.col("node") - 1) / fanout).alias("node"), F.pmod(F.col("node") - 1, F.lit(fanout)).cast("int").alias("slot"),
            F.col("node").alias("child"), "n", "radius",
        )
        inner.append(
            materialize(  # at most ``fanout`` rows a group
                children.join(routes.select("node", "centres", "ups", "children"), "node").groupBy("node").applyInPandas(_inner_row, INNER),
                "tree-inner",
            )
        )
        leaves.append(points.join(routes.select("node"), "node", "left_anti").select(points.columns))
        points = moved
    settled = reduce(DataFrame.unionByName, leaves)
    salts = settled.groupBy("node").agg(F.ceil(F.count("*") / page_rows).alias("salts"))
    paged = settled.join(salts, "node").withColumn("salt", F.pmod(F.xxhash64("row"), "salts").cast("int"))
    pages = paged.select("node", "salt", "vec_id", "parent", "data").groupBy("node", "salt").applyInPandas(_page, PAGE)
    return Tree(dims, largest, root, inner, materialize(pages, "tree-pages"))


def highest_score(largest: float, q: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The highest score of anything at a distance of ``gap`` or more."""
    norm = np.einsum("ij,ij->i", q, q)[:, None] + largest
    return (norm - np.maximum(0.0, gap) ** 2 * (1 - SLACK)) / 2 + SLACK * norm + 1


def ceilings(
    largest: float, q: np.ndarray, to_node: np.ndarray, bound: np.ndarray, centres: np.ndarray, ups: np.ndarray, radii: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries to a node's children and the highest score that each
    can hold; -inf for a child below the bound, and for one that the stored parent
    distance alone rules out for every query the distance is not computed."""
    ceiling = highest_score(largest, q, np.abs(to_node[:, None] - ups[None, :]) - radii[None, :])
    near = np.zeros(ceiling.shape)
    some = np.flatnonzero((ceiling >= bound[:, None]).any(axis=0))
    near[:, some] = distances(np.hstack([q, np.zeros((len(q), 1))]), centres[some])
    ceiling[:, some] = np.minimum(ceiling[:, some], highest_score(largest, q, near[:, some] - radii[None, some]))
    ceiling[ceiling < bound[:, None]] = -np.inf
    return near, ceiling


BLOCK = "node long, query_ids binary, queries binary, bounds binary, distances binary"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def descend(tree: Tree, blocks: DataFrame, k: int, first: bool) -> DataFrame:
    """Blocks of queries at each node they visit, from the root to the leaves.

    ``first``: only the best children, until they hold 4 k + 1 vectors; else all
    that can hold a score of the query's bound or more.
    """
    dims, largest = tree.dims, tree.largest

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, bound, at = (np.frombuffer(row[c], t) for c, t in (("query_ids", "<i8"), ("bounds", "<f8"), ("distances", "<f8")))
                q = np.frombuffer(row["queries"], "<i8").reshape(len(qid), dims)
                slots, counts = (np.frombuffer(row[c], "<i8") for c in ("slots", "counts"))
                ups, radii = (np.frombuffer(row[c], "<f8") for c in ("ups", "radii"))
                centres = np.frombuffer(row["centres"], "<f8").reshape(len(slots), dims + 1)
                near, ceiling = ceilings(largest, q.astype(float), at, bound, centres, ups, radii)
                wanted = ceiling > -np.inf
                if first:
                    order = np.argsort(-ceiling, axis=1, kind="stable")
                    held = counts[order]
                    np.put_along_axis(wanted, order, np.cumsum(held, axis=1) - held < 4 * k + 1, axis=1)
                out: list[list] = [[] for _ in BLOCK_COLUMNS]
                for j in np.flatnonzero(wanted.any(axis=0)):
                    rows = wanted[:, j]
                    for held, value in zip(out, (int(slots[j]), qid[rows], q[rows], bound[rows], near[rows, j]), strict=True):
                        held.append(value if isinstance(value, int) else value.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=BLOCK_COLUMNS
                )

    visited, front = [blocks], blocks
    for children in tree.inner:
        front = materialize(front.join(children, "node").mapInArrow(expand, BLOCK), "front")
        visited.append(front)
    return reduce(DataFrame.unionByName, visited)


def scan(tree: Tree, visits: DataFrame, k: int) -> DataFrame:
    """query_id, query, node, vec_id, score, rank of the ``k`` best in the visited pages."""
    dims, largest = tree.dims, tree.largest

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, ids = (np.frombuffer(row[c], "<i8") for c in ("query_ids", "ids"))
                q = np.frombuffer(row["queries"], "<i8").reshape(len(qid), dims).astype(float)
                bound, at, parent = (np.frombuffer(row[c], "<f8") for c in ("bounds", "distances", "parents"))
                near = highest_score(largest, q, np.abs(at[:, None] - parent[None, :])) >= bound[:, None]
                some = np.flatnonzero(near.any(axis=0))
                x = np.frombuffer(row["data"], "<i8").reshape(len(ids), dims)[some].astype(float)
                score = q @ x.T
                fits = near[:, some] & (score >= bound[:, None]) & (qid[:, None] != ids[some][None, :])
                out: list[list] = [[], [], [], []]
                for i in np.flatnonzero(fits.any(axis=1)):
                    hit = np.flatnonzero(fits[i])  # by vec_id, so a stable sort breaks ties by it
                    best = hit[np.argsort(-score[i, hit], kind="stable")[:k]]
                    out[0].append(np.full(len(best), qid[i]))
                    out[1].extend([q[i].astype("<i8").tobytes()] * len(best))
                    out[2].append(ids[some][best])
                    out[3].append(score[i, best].astype(np.int64))
                if out[0]:
                    total = sum(map(len, out[0]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(out[0])), pa.array(out[1], pa.binary()),
                            pa.array(np.full(total, row["node"])),
                            pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3])),
                        ],
                        names=["query_id", "query", "node", "vec_id", "score"],
                    )

    met = visits.join(tree.pages, "node")
    found = met.mapInArrow(visit, "query_id long, query binary, node long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_blocks(tree: Tree, queries: DataFrame, block_rows: int) -> DataFrame:
    """query_id, query, home, bound -> blocks at the root, of one home and about
    ``block_rows`` queries each."""
    dims, largest, root = tree.dims, tree.largest, tree.root

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query_id", "query"], kind="stable")
        q = np.frombuffer(b"".join(frame["query"]), "<i8").reshape(len(frame), dims)
        at = distances(np.hstack([q.astype(float), np.zeros((len(q), 1))]), root[None, :])[:, 0]
        values = (frame["query_id"].to_numpy("<i8"), q, frame["bound"].to_numpy("<f8"), at)
        return pd.DataFrame([(0, *(v.tobytes() for v in values))], columns=BLOCK_COLUMNS)

    homes = queries.groupBy("home").agg(F.ceil(F.count("*") / block_rows).alias("salts"))
    salted = queries.join(homes, "home").withColumn("salt", F.pmod(F.xxhash64("query_id", "query"), "salts"))
    packed = salted.select("home", "salt", "query_id", "query", "bound").groupBy("home", "salt").applyInPandas(pack, BLOCK)
    return materialize(packed, "blocks")


def start_of(tree: Tree, queries: DataFrame) -> DataFrame:
    """query_id, query as stored in pages, home 0, no bound: one row for each vector of a query."""
    dims = tree.dims

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1).to_pylist(), dims)
            data = pa.array([row.tobytes() for row in q.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["query_id", "query"])

    rows = queries.mapInArrow(packed, "query_id long, query binary").distinct()
    none = F.lit(float("-inf"))
    return materialize(rows.select("query_id", "query", F.lit(0).cast("long").alias("home"), none.alias("bound")), "queries")


def bounded(tree: Tree, start: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``start`` with the leaf of its best find as home and a score that the k-th reaches."""
    found = materialize(scan(tree, descend(tree, in_blocks(tree, start, block_rows), k, True), k), "first-found")
    best = found.groupBy("query_id", "query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("node"))).alias("home"),
        F.max(F.when(F.col("rank") == k, F.col("score").cast("double"))).alias("bound"),
    )
    return materialize(
        start.select("query_id", "query").join(best, ["query_id", "query"], "left").select(
            "query_id", "query", F.coalesce("home", F.lit(0).cast("long")).alias("home"),
            F.coalesce("bound", F.lit(float("-inf"))).alias("bound"),
        ),
        "bounded",
    )


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    vector: str = "embedding",
    fanout: int = 16,
    page_rows: int = 512,
    block_rows: int = 128,
    sample_rows: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of
    integer vectors for each row of ``is_query``, among all rows of another id.

    Ties go to the smaller vec_id.  Vectors that are null or hold a null or a
    non-finite component take no part; shorter vectors count as padded with
    zeros.  Repeated candidate rows appear each; a query row repeated as it is
    counts once, rows that share an id but not the vector are searched each.
    Null ids take no part.  Empty tables give no rows; other columns are not read.
    A vector whose squared norm is 2^53 or more, as integers, is a ValueError:
    its scores would not be exact.
    """
    vectors = integer_vectors(rows, vector).where(F.col("vec_id").isNotNull())
    tree = build(vectors, fanout, page_rows, sample_rows)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    start = start_of(tree, vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "vector"))
    blocks = in_blocks(tree, bounded(tree, start, k, block_rows), block_rows)
    return scan(tree, descend(tree, blocks, k, False), k).select("query_id", "rank", "vec_id", "score")
