"""Exact top-k inner products by a dual-tree search over cover trees.

A cover tree is a series of nested nets. Level i has a scale r_i: its centers are more than r_i apart, and every row lies within r_i of one (scales fall by
`BASE`; levels that add no center are left out). Each center hangs below its nearest one of the level above. Centers are found farthest first, which gives all nets in one
go, down to the last level whose net has at most a `SPARSE`-th of the rows: where distances hardly differ, a finer net would be the rows themselves.
A node knows its covering radius, the largest distance to a row below it. Rows lie in the order of the leaves, so a node is a range of rows and a tree a few arrays.

Queries and data share one index. Its upper part is a cover tree of a bounded sample (at most `SAMPLE` vectors; only balance and speed depend on it). Every
row goes down to a leaf of it, whose covering radius is the largest distance found over all its rows. Small leaves that follow each other share a block
and crowded ones are dealt to several. A block has a cover tree of its own; both travel packed, in the least kind of number that holds them, and the tree serves every search of the block.

1. Each block is searched for the queries that live in it, which gives each query a first kth score.
2. Queries of neighbouring leaves form chunks, with a cover tree each. A chunk asks only for blocks with a leaf whose bound, by the covering radius, reaches
   the kth score of one of its queries. Just these pairs of a chunk and a block are made, at most `TOGETHER` blocks to a task.
3. Within a task, the trees of the chunk and of each block are walked down in pairs, level by level; a pair of nodes is pruned when
   its bound by both covering radii stays under the worst kth score of its queries, which rises from block to block and from leaf to leaf.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part. Rows that repeat
an id, with equal or other vectors, are candidates each; as queries they share one ranking of all their scores, and none
of them is a candidate of this id. Vectors meet only those of their own dimension; scaled components beyond the range of a double are held at its ends, and scores
beyond 64 bits at the ends of theirs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import checkpointed, col

SAMPLE, BLOCK, CHUNK, TOGETHER = 32_768, 4096, 16_384, 16
#: Pairs of a chunk and a block share a task only where there are more than so many.
TASKS = 256
BASE, SPARSE = 1.3, 16
#: Centers that a tree over queries may have beyond a SPARSE-th of them.
NET = 1024
#: Pairs of nodes whose bounds are computed at once, and rows of data in a leaf's first product and in its largest.
PAIRS, FIRST, WIDTH = 1 << 14, 64, 2048
EXACT = float(1 << 53)
#: Components beyond it have squares that a double may not hold.
HUGE = 1e150
MOST = np.finfo("f8").max


@dataclass
class Tree:
    """Nodes level by level, a level's in the order of their parents, and rows in the order of the leaves.

    levels: where each level's nodes begin, and the end. Of a node: its center (a row), its covering radius, its rows [start, stop) and its children [first, last).
    scale: of each level.
    """

    levels: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray
    scale: np.ndarray

    def packed(self) -> bytes:
        whole = [self.levels, self.center, self.start, self.stop, self.first, self.last]
        return np.array([len(self.levels), len(self.center)], "<i4").tobytes() + b"".join(a.astype("<i4").tobytes() for a in whole) + self.radius.astype("<f8").tobytes() + self.scale.astype("<f8").tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Tree:
        depth, n = np.frombuffer(raw, "<i4", 2).tolist()
        cut = np.cumsum([0, depth, *[n] * 5])
        levels, center, start, stop, first, last = (np.frombuffer(raw, "<i4", cut[i + 1] - cut[i], 8 + 4 * cut[i]).astype("i8") for i in range(6))
        radius, scale = np.split(np.frombuffer(raw, "<f8", -1, 8 + 4 * cut[-1]), [n])
        return Tree(levels, center, radius, start, stop, first, last, scale)

    def worst(self, need: np.ndarray) -> np.ndarray:
        """Of each node the least that one of its rows needs."""
        return np.concatenate([np.minimum.reduceat(need, self.start[a:b]) for a, b in zip(self.levels[:-1], self.levels[1:], strict=True)])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x - y, axis=1)


def cover_tree(x: np.ndarray, most: int | None = None) -> tuple[Tree, np.ndarray]:
    """The tree over the rows of x, and the order of rows that it is meant for. most: centers at most; a SPARSE-th of the rows by default."""
    n = len(x)
    most = n // SPARSE if most is None else most
    found, nearest = [0], np.zeros(n, "i8")
    far = distances(x, x[:1]) if np.abs(x).max(initial=0) < HUGE else np.full(n, np.inf)
    scale, nets, sizes = [far.max()], [nearest.copy()], [1]
    r = far.max()
    while 0 < far.max() < np.inf and len(found) < most:
        r /= BASE
        while far.max() > r and len(found) <= most:
            new = int(far.argmax())
            d = distances(x, x[new])
            nearest[d < far] = len(found)
            far = np.minimum(far, d)
            found.append(new)
        if len(found) > most:
            break
        if len(found) > sizes[-1]:
            scale.append(r)
            nets.append(nearest.copy())
            sizes.append(len(found))
    # From the root down: the centers of a level in the order of their parents.
    rows = np.array(found)
    order, place, parents = [np.zeros(1, "i8")], [np.zeros(1, "i8")], []
    for above, size in zip(nets, sizes[1:], strict=False):
        up = place[-1][above[rows[:size]]]
        own = np.argsort(up, kind="stable")
        order.append(own)
        parents.append(up[own])
        place.append(np.argsort(own))
    leaf = place[-1][nets[-1]]
    by_leaf = np.argsort(leaf, kind="stable")
    at = np.argsort(by_leaf)
    levels = np.cumsum([0, *sizes])
    start, stop, radius, owner = [], [], [], leaf[by_leaf]
    for i in range(len(sizes) - 1, -1, -1):
        cut = np.searchsorted(owner, np.arange(sizes[i] + 1))
        start.insert(0, cut[:-1])
        stop.insert(0, cut[1:])
        away = distances(x[by_leaf], x[rows[order[i]]][owner]) if np.isfinite(scale[0]) else np.full(n, np.inf)
        radius.insert(0, np.maximum.reduceat(away, cut[:-1]))
        owner = parents[i - 1][owner] if i else owner
    first, last = np.zeros(levels[-1], "i8"), np.zeros(levels[-1], "i8")
    for i, up in enumerate(parents):
        cut = np.searchsorted(up, np.arange(sizes[i] + 1)) + levels[i + 1]
        first[levels[i] : levels[i + 1]], last[levels[i] : levels[i + 1]] = cut[:-1], cut[1:]
    centers = np.concatenate([at[rows[o]] for o in order])
    return Tree(levels, centers, np.concatenate(radius), np.concatenate(start), np.concatenate(stop), first, last, np.array(scale)), by_leaf


def query_tree(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over queries goes further down, for a leaf is only as good as the worst of its queries."""
    return cover_tree(x, min(len(x) // 4, max(NET, len(x) // SPARSE)))


class Best:
    """The k best (score, then smaller id) of each query, and the score that a candidate has to reach."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k, self.need = k, floor.copy()
        self.scores: list[np.ndarray] = [np.empty(0)] * len(floor)
        self.ids: list[np.ndarray] = [np.empty(0, "i8")] * len(floor)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            least = float(scores[order[-1]])  # rounded down, so that equal scores still reach it
            self.need[q] = max(self.need[q], np.nextafter(least, -np.inf) if least > scores[order[-1]] else least)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products as floats, or as Python's whole numbers, held between -2**63 and 2**63, where floats would not be exact."""
    if not a.size or not b.size:
        return a @ b.T
    large = np.abs(b).max(axis=1) * np.abs(a).max() >= EXACT / a.shape[1]
    if not large.any():
        return a @ b.T
    out = np.empty((len(a), len(b)), object)
    out[:, ~large] = [[int(v) for v in row] for row in a @ b[~large].T]
    whole = [[int(t) for t in q] for q in b[large]]
    out[:, large] = [[max(-(1 << 63), min(1 << 63, sum(s * t for s, t in zip(p, q, strict=True)))) for q in whole] for p in ([int(s) for s in p] for p in a)]
    return out


def bounds(a: Tree, i: np.ndarray, x: np.ndarray, b: Tree, j: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least every inner product of rows below nodes i and j."""
    out = np.empty(len(i))
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            u, v = x[a.center[p]], y[b.center[q]]
            ru, rv = a.radius[p], b.radius[q]
            most = np.einsum("ij,ij->i", u, v) + ru * np.linalg.norm(v, axis=1) + rv * np.linalg.norm(u, axis=1) + ru * rv
            out[at : at + PAIRS] = most + 1e-9 * np.abs(most) + 1e-3
    return out


def dual_search(best: Best, tree: Tree, queries: np.ndarray, query_ids: np.ndarray, below: Tree, data: np.ndarray, ids: np.ndarray) -> int:
    """Adds the candidates among data that reach what each query needs, without the query's own id; returns how many pairs were scored.

    tree: over queries; below: over data.
    """
    i, j, most = np.zeros(1, "i8"), np.zeros(1, "i8"), np.full(1, np.inf)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    worst = tree.worst(best.need)
    while len(i):
        ends = (tree.first[i] == tree.last[i]) & (below.first[j] == below.last[j])
        leaves.append((i[ends], j[ends], most[ends]))
        i, j = i[~ends], j[~ends]
        # The larger node of a pair is opened, if it has children.
        left = (tree.last[i] > tree.first[i]) & ((below.last[j] == below.first[j]) | (tree.radius[i] > below.radius[j]))
        n = np.where(left, tree.last[i] - tree.first[i], below.last[j] - below.first[j])
        each = np.repeat(np.arange(len(i)), n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.where(left[each], tree.first[i][each] + step, i[each]), np.where(left[each], j[each], below.first[j][each] + step)
        most = bounds(tree, i, queries, below, j, data)
        reach = ~(most < worst[i])  # a bound that is no number prunes nothing
        i, j, most = i[reach], j[reach], most[reach]
    i, j, most = (np.concatenate(c) for c in zip(*leaves, strict=True))
    order = np.lexsort((-most, i))
    scored = 0
    for own in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        if not len(own):
            continue
        rows = np.arange(tree.start[i[own[0]]], tree.stop[i[own[0]]])
        at, width = 0, FIRST
        while at < len(own):  # the best leaves of the data first, few rows at a time, so that the rest may fall out
            least, some, held = best.need[rows].min(), [], 0
            while at < len(own) and held < width:
                if not most[own[at]] < least:
                    some.append(np.arange(below.start[j[own[at]]], below.stop[j[own[at]]]))
                    held += len(some[-1])
                at += 1
            width = min(2 * width, WIDTH)
            for cut in range(0, held, WIDTH):
                there = np.concatenate(some)[cut : cut + WIDTH]
                scores = products(queries[rows], data[there])
                scored += scores.size
                reach = (scores >= best.need[rows][:, None]) & (ids[there][None, :] != query_ids[rows][:, None])
                for q in np.flatnonzero(reach.any(axis=1)):
                    best.add(rows[q], scores[q, reach[q]], ids[there][reach[q]])
    return scored


def results(best: Best, query_ids: np.ndarray) -> pd.DataFrame:
    n = [len(s) for s in best.scores]
    scores = [min(max(int(s), -(2**63)), 2**63 - 1) for one in best.scores for s in one]
    ids = np.concatenate(best.ids) if best.ids else np.empty(0, "i8")
    return pd.DataFrame({"query_id": np.repeat(query_ids, n), "vec_id": ids.astype("i8"), "score": np.array(scores, "i8")})


FOUND = "query_id long, vec_id long, score long"


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), "f8").reshape(len(vectors), -1)


def packed(x: np.ndarray) -> dict[str, object]:
    """A matrix of whole numbers in the least kind of number that holds them."""
    top = np.abs(x).max() if x.size else 0
    kind = next((t for t in ("<i2", "<i4") if top <= np.iinfo(t).max), "<f8")
    return {"dim": x.shape[1], "kind": kind, "x": x.astype(kind).tobytes()}


def unpacked(row: object) -> np.ndarray:
    return np.frombuffer(row.x, row.kind).astype("f8").reshape(len(row.ids) // 8, row.dim)


def vectors_of(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (floor of the scaled components) of the rows that take part."""
    usable = F.forall(col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(col(vector_col), lambda x: x.cast("double"))
    rows = rows.where(col(id_col).isNotNull() & col(vector_col).isNotNull() & usable).select(col(id_col).cast("long").alias("vec_id"), whole.alias("v"))

    def scaled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            with np.errstate(over="ignore"):
                yield part.assign(v=[np.clip(np.floor(scale * np.asarray(v, "f8")), -MOST, MOST) for v in part["v"]])

    return rows.mapInPandas(scaled, "vec_id long, v array<double>")


class Pivots:
    """The upper part of the index: a cover tree of the sample for each dimension, with numbered leaves in order."""

    def __init__(self, sample: list[np.ndarray], n: int) -> None:
        self.leaves: list[np.ndarray] = []
        self.roots: dict[int, tuple[Tree, np.ndarray, int]] = {}
        usable = [v for v in sample if np.abs(v).max(initial=0) < HUGE]
        for dim in sorted({len(v) for v in usable}):
            x = np.stack([v for v in usable if len(v) == dim])
            tree, order = cover_tree(x, max(1, min(len(x) // SPARSE, 4 * math.ceil(n * len(x) / len(sample) / BLOCK))))
            self.roots[dim] = tree, x[order][tree.center], len(self.leaves) - tree.levels[-2]
            self.leaves += list(x[order][tree.center[tree.levels[-2] :]])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every level; -1 - dimension where the sample has none of it, and for huge rows."""
        out = np.full(len(x), -1 - x.shape[1], "i8")
        if x.shape[1] not in self.roots:
            return out
        tree, centers, shift = self.roots[x.shape[1]]
        todo = [(0, np.flatnonzero(np.abs(x).max(axis=1, initial=0) < HUGE))]
        while todo:
            node, at = todo.pop()
            children = np.arange(tree.first[node], tree.last[node])
            if not len(children):
                out[at] = node + shift
            elif len(at):
                nearest = children[np.stack([distances(x[at], centers[c]) for c in children]).argmin(axis=0)] if len(children) > 1 else np.full(len(at), children[0])
                todo += [(int(c), at[nearest == c]) for c in np.unique(nearest)]
        return out

    def center(self, leaf: int) -> np.ndarray:
        return self.leaves[leaf] if leaf >= 0 else np.zeros(-1 - leaf)


class Blocks:
    """Which block and chunk the rows of each leaf go to: at most SAMPLE leaves, and one for each dimension that the sample missed."""

    def __init__(self, pivots: Pivots, stats: list[tuple[int, int, int, float]]) -> None:
        stats = sorted(stats, key=lambda s: (len(pivots.center(s[0])), s[0]))
        self.at = {leaf: i for i, (leaf, *_) in enumerate(stats)}
        self.centers = [pivots.center(leaf) for leaf, *_ in stats]
        self.radius = np.array([s[3] for s in stats])
        dims = [len(c) for c in self.centers]
        self.blocks = self.dealt(dims, [s[1] for s in stats], BLOCK)
        self.chunks = self.dealt(dims, [s[2] for s in stats], CHUNK)

    @staticmethod
    def dealt(dims: list[int], counts: list[int], most: int) -> np.ndarray:
        """The first place of each leaf and how many it is dealt to. Leaves in a row share one while they fit, if of one dimension."""
        out, place, held = [], 0, 0
        for i, n in enumerate(counts):
            if held and (held + n > most or dims[i] != dims[i - 1]):
                place, held = place + 1, 0
            many = max(1, math.ceil(n / most))
            out.append((place, many))
            held += n
            if many > 1:
                place, held = place + many, 0
        return np.array(out, "i8").reshape(-1, 2)

    def places(self, leaf: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, back = np.unique(leaf, return_inverse=True)
        own = np.array([self.at[i] for i in known.tolist()], "i8")[back]
        return tuple(self.blocks_of(p, own, turn) for p in (self.blocks, self.chunks))

    @staticmethod
    def blocks_of(places: np.ndarray, own: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return places[own, 0] + turn % places[own, 1]

    def reached(self, x: np.ndarray, floor: np.ndarray) -> list[int]:
        """Blocks with a leaf whose bound reaches the floor of some query."""
        norm, out = np.where(np.abs(x).max(axis=1, initial=0) < HUGE, np.linalg.norm(x, axis=1), np.inf)[:, None], set()
        same = [i for i, c in enumerate(self.centers) if len(c) == x.shape[1]]
        for at in range(0, len(same), 256):
            some = same[at : at + 256]
            with np.errstate(invalid="ignore", over="ignore"):
                most = x @ np.stack([self.centers[i] for i in some]).T + norm * self.radius[some]
                near = (~(most + 1e-9 * np.abs(most) + 1e-3 < floor[:, None])).any(axis=0)
            for i in np.array(some)[near].tolist():
                first, many = self.blocks[i].tolist()
                out.update(range(first, first + many))
        return sorted(out)


BLOB = "ids binary, dim int, kind string, x binary, tree binary"


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score. is_query: a condition on column vec_id."""
    sc = rows.sparkSession.sparkContext
    data = checkpointed(vectors_of(rows, scale, id_col, vector_col))
    n = data.count()
    size = min(SAMPLE, max(2048, 32 * math.ceil(n / BLOCK)))
    sample = data.orderBy(F.xxhash64("vec_id", "v")).limit(size).select("v").collect()
    pivots = sc.broadcast(Pivots([np.array(r.v, "f8") for r in sample], n))

    def descended(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.assign(leaf=0, dist=0.0)
            for at in part.groupby(part["v"].map(len)).groups.values():
                x = stacked(part.loc[at, "v"])
                leaf = pivots.value.leaf(x)
                for own in np.unique(leaf).tolist():
                    away = distances(x[leaf == own], pivots.value.center(own)) if own >= 0 else np.inf
                    part.loc[at[leaf == own], "dist"] = away
                part.loc[at, "leaf"] = leaf
            yield part

    placed = data.mapInPandas(descended, "vec_id long, v array<double>, leaf long, dist double")
    placed = checkpointed(placed.select("vec_id", "v", "leaf", "dist", is_query.alias("asks"), F.monotonically_increasing_id().alias("turn")))
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), F.max("dist").alias("radius"))
    blocks = sc.broadcast(Blocks(pivots.value, [tuple(r) for r in stats.collect()]))

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            block, chunk = blocks.value.places(part["leaf"].to_numpy(), part["turn"].to_numpy())
            yield part[["vec_id", "v", "asks"]].assign(block=block, chunk=chunk)

    numbers = placed.mapInPandas(numbered, "vec_id long, v array<double>, asks boolean, block long, chunk long")

    def within(block: pd.DataFrame) -> pd.DataFrame:
        """The packed block with its tree, and what its own queries find in it."""
        ids, x, asks = block["vec_id"].to_numpy("i8"), stacked(block["v"]), block["asks"].to_numpy(bool)
        tree, order = cover_tree(x)
        ids, x, asks = ids[order], x[order], asks[order]
        best, own = Best(k, np.full(asks.sum(), -np.inf)), ids[asks]
        if asks.any():
            above, turn = query_tree(x[asks])
            own = own[turn]
            dual_search(best, above, x[asks][turn], own, tree, x, ids)
        found = results(best, own).to_dict("records")
        return pd.DataFrame([{"block": block["block"].iloc[0], "ids": ids.tobytes(), **packed(x), "tree": tree.packed(), "found": found}])

    held = checkpointed(numbers.groupBy("block").applyInPandas(within, f"block long, {BLOB}, found array<struct<{FOUND.replace(' ', ':')}>>".replace(",:", ", ")))
    near = held.select(F.inline("found"))
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    asking = numbers.where("asks").join(kth, F.col("vec_id") == F.col("query_id"), "left")
    asking = asking.select("vec_id", "v", "block", "chunk", F.when((F.col("n") >= k) & (F.col("kth") > -(1 << 63)), F.col("kth") - F.when(F.abs("kth") >= 1 << 53, 2048).otherwise(0)).cast("double").alias("floor"))

    def gathered(chunk: pd.DataFrame) -> pd.DataFrame:
        """The packed chunk and the blocks that it asks for."""
        x = stacked(chunk["v"])
        tree, order = query_tree(x)
        chunk, x = chunk.iloc[order], x[order]
        floor = chunk["floor"].fillna(-np.inf).to_numpy("f8")
        row = {"chunk": chunk["chunk"].iloc[0], "ids": chunk["vec_id"].to_numpy("i8").tobytes(), **packed(x), "tree": tree.packed(), "floors": floor.tobytes()}
        return pd.DataFrame([row | {"homes": chunk["block"].to_numpy("i8").tobytes(), "blocks": blocks.value.reached(x, floor)}])

    asked = checkpointed(asking.groupBy("chunk").applyInPandas(gathered, f"chunk long, {BLOB}, floors binary, homes binary, blocks array<long>"))
    n_pairs = asked.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    together = max(1, min(TOGETHER, n_pairs // TASKS))
    pairs = asked.select("chunk", F.explode("blocks").alias("block")).withColumn("some", F.floor(F.col("block") / together))
    left = pairs.select("chunk", "some").distinct().join(asked.drop("blocks"), "chunk")
    left = left.select(F.col("chunk").alias("by"), F.col("some").alias("part"), "ids", "dim", "kind", "x", "tree", "floors", "homes")
    right = pairs.join(held.drop("found"), "block")

    def across(chunk: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        chunk = next(chunk.itertuples())
        queries, ids, homes = unpacked(chunk), np.frombuffer(chunk.ids, "i8"), np.frombuffer(chunk.homes, "i8")
        best, tree = Best(k, np.frombuffer(chunk.floors, "f8")), Tree.unpacked(chunk.tree)
        for block in some.sort_values("block").itertuples():
            need = best.need.copy()
            best.need[homes == block.block] = np.inf  # searched before
            dual_search(best, tree, queries, ids, Tree.unpacked(block.tree), unpacked(block), np.frombuffer(block.ids, "i8"))
            best.need[homes == block.block] = need[homes == block.block]
        return results(best, ids)

    far = left.groupBy("by", "part").cogroup(right.groupBy("chunk", "some")).applyInPandas(across, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
