"""Exact pairwise vector work without cross joins: eps-range pairs, kNN, top-k search.

Range pairs.  Projections on orthonormal directions never lengthen distances, so
vectors within eps lie in neighbouring eps-wide cells along the leading principal
directions, and two blocks whose bounding boxes (over more directions) are farther
apart than eps hold no pair.  Block pairs (*tiles*) come from an equi-join of the
small block table on neighbouring cells; cells holding many vectors are split by a
key hash; each vector travels only to its block's surviving tiles.  Cells are no finer than
the table needs and blocks grow with it (``block_size``), so that a vector travels to a number of
tiles that does not grow.

Core graphs.  Density clustering needs no pairs, only each point's number of neighbours and what is
connected: a tile returns its rows' counts and a spanning forest, at most one edge a row however
many pairs lie within eps.  In a large table each vector first meets two groups of ``FIRST_ROWS``: a pair of points that
have their neighbours and are linked into a graph's largest component already can add nothing, so that after this only the
other points (noise, small components) meet all vectors.  Where those are more than half, all blocks meet.

kNN.  Rings around one pivot vector, |d(x,p) - d(y,p)| <= d(x,y): a first pass over
each block alone bounds every block's search radius, a second scores the tiles within
reach.  On data without ring structure that is all pairs, spread over bounded tasks.

Kernel.  One ``applyInPandas`` or ``applyInArrow`` per tile computes the tile's distance matrix in
numpy (float64, Gram form, some rows at a time) and returns only the answers: pairs within eps, or
each row's k best.  The pairs of a tile are never materialised as rows.  Results are exact.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.session import hold

BLOCK_ROWS = 1024  # a block's rows at least
BLOCKS, MAX_BLOCK_ROWS = 16, 32_768  # blocks of a table aimed at; a block's rows at most, whatever the table's size
STRIP = 1 << 20  # distances computed at a time
FIRST_FROM, FIRST_ROWS = 65_536, 4096  # rows from which a table is compared in groups first; a group's rows


def block_size(n: int, block_rows: int | None = None) -> int:
    """Rows of a block of a table of ``n`` rows, where not given: about ``BLOCKS`` blocks, so that the tiles a
    vector is shipped to do not grow with the table until a block holds ``MAX_BLOCK_ROWS``."""
    return block_rows or max(BLOCK_ROWS, min(-(-n // BLOCKS), MAX_BLOCK_ROWS))


def _with_blocks(df: DataFrame, key: str, vec: str, width: float, block_rows: int) -> DataFrame:
    """Adds ``ring`` and ``sub`` (block) columns."""
    # one vector (d numbers) as a literal: subqueries may not sit in lambdas
    row = df.select(F.min_by(F.col(vec).cast("array<double>"), F.col(key))).first()
    pivot = F.array(*[F.lit(float(x)) for x in (row[0] or [])])
    d = VF.euclidean(F.col(vec), pivot)
    ringed = df.withColumn("ring", F.floor(F.coalesce(d, F.lit(0.0)) / F.lit(float(width))).cast("long"))
    sizes = ringed.groupBy("ring").agg(F.count(F.lit(1)).alias("ring_n"))
    nsub = F.greatest(F.ceil(F.col("ring_n") / F.lit(block_rows)), F.lit(1)).cast("long")
    return (ringed.join(sizes, "ring")
            .withColumn("sub", F.pmod(F.xxhash64(F.col(key)), nsub))
            .drop("ring_n"))


def _blocks(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("ring", "sub").agg(F.count(F.lit(1)).alias("bn"))


def _tiles_within(reach_tbl: DataFrame) -> DataFrame:
    """Unordered block pairs whose ring gap is within the reach ``g`` of
    either block (equi-join on ring offsets, then de-duplicated)."""
    a = (reach_tbl.select(F.col("ring").alias("ra"), F.col("sub").alias("sa"), "g")
         .withColumn("rb", F.explode(F.sequence(F.col("ra") - F.col("g"), F.col("ra") + F.col("g")))))
    b = reach_tbl.select(F.col("ring").alias("rb"), F.col("sub").alias("sb"))
    p = a.join(b, "rb")
    first = (F.col("ra") < F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("sa") <= F.col("sb")))
    return p.select(F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("r1"),
                    F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("s1"),
                    F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("r2"),
                    F.when(first, F.col("sb")).otherwise(F.col("sa")).alias("s2")).distinct()


def _ship(blocked: DataFrame, tiles: DataFrame, key: str, vec: str, *more: str) -> DataFrame:
    """Each vector to every tile of its block; side 0 = left, 1 = right, 2 = both."""
    t = tiles.withColumn("tile", F.struct("r1", "s1", "r2", "s2"))
    diag = (F.col("r1") == F.col("r2")) & (F.col("s1") == F.col("s2"))
    base = blocked.select(key, F.col(vec).cast("array<double>").alias("v"), "ring", "sub", *more)
    as_left = base.join(t.select(F.col("r1").alias("ring"), F.col("s1").alias("sub"), "tile",
                                 F.when(diag, 2).otherwise(0).alias("side")), ["ring", "sub"])
    as_right = base.join(t.filter(~diag).select(F.col("r2").alias("ring"), F.col("s2").alias("sub"), "tile",
                                                F.lit(1).alias("side")), ["ring", "sub"])
    return as_left.unionByName(as_right).select("tile", "side", key, "v", *more)


def _sqdist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def principal_directions(df: DataFrame, vec: str, k: int) -> np.ndarray:
    """``k`` leading orthonormal principal directions (k x d) of a vector column: each task sums its
    vectors' products, d x d numbers come to the driver.  No rows: shape (0, 0)."""
    def moments(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                one = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["m"])

    parts = df.select(F.col(vec).cast("array<double>")).mapInArrow(moments, "m array<double>")
    rows = parts.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    if not rows:
        return np.zeros((0, 0))
    n, *rest = [r["s"] for r in rows]
    d = int(np.sqrt(len(rest) + 0.25) - 0.5 + 1e-6)  # (d + d * d numbers)
    mean, square = np.array(rest[:d]) / n, np.array(rest[d:]).reshape(d, d) / n
    spread = square - np.outer(mean, mean)
    if not np.isfinite(spread).all():  # (any directions are right, they only prune)
        return np.eye(d)[:k]
    return np.linalg.eigh(spread)[1].T[::-1][:k]


def _cells(df: DataFrame, key: str, width: float, block_rows: int | None, cell_dims: int, box_dims: int) -> DataFrame:
    """Adds ``p`` (projections on the principal directions) and ``block`` = (cell, sub).

    An orthonormal projection never lengthens a distance, so vectors within ``width`` lie in
    neighbouring cells of that width; a cell with more than a block's vectors is split by a
    key hash."""
    axes = principal_directions(df, "v", box_dims)
    if not len(axes):
        axes = np.zeros((1, 1))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                p = x @ axes.T if x.shape[1] else np.zeros((len(x), len(axes)))
                yield batch.append_column("p", pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64())))

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", p array<double>"
    t = hold(df.mapInArrow(project, schema), "cells")
    n, *spans = t.agg(F.count(F.lit(1)), *[F.max(F.col("p")[j]) - F.min(F.col("p")[j]) for j in range(min(cell_dims, len(axes)))]).first()
    rows = block_size(n, block_rows)
    # cells of ``width`` or, where blocks are sized here, wider ones, about four a block: finer ones only ship
    # a vector to more tiles.  A direction along which all vectors span two widths or less cannot separate anything
    left, cell = math.inf if block_rows else 4 * n / rows, []
    for j, span in enumerate(spans):
        some = min(span / width, left) if span is not None and math.isfinite(span) else 0
        if some > 2:
            cell.append(F.floor(F.col("p")[j] / F.lit(max(width, span / some))))
            left /= some
    t = t.withColumn("cell", F.array(*cell).cast("array<bigint>"))
    sizes = t.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_n"))
    split = F.ceil(F.col("cell_n") / F.lit(rows)).cast("long")
    out = (t.join(sizes, "cell")
           .withColumn("block", F.struct("cell", F.pmod(F.xxhash64(F.col(key)), split).alias("sub"))).drop("cell_n"))
    out._rows = n
    return out


def _boxes(blocked: DataFrame) -> DataFrame:
    """``(block, probe, box)``: each block's bounding box over all projections."""
    j = F.posexplode("p").alias("axis", "value")
    box = blocked.select("block", j).groupBy("block", "axis").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    box = box.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("axis", "lo", "hi"))).alias("box"))
    return blocked.groupBy("block").agg(F.max("probe").alias("probe")).join(box, "block")


def near_tiles(blocked: DataFrame, radius: float, others: DataFrame | None = None) -> DataFrame:
    """Block pairs ``(a, b)``, a <= b, that may hold a pair within ``radius``: an equi-join of the
    block table on neighbouring cells, less the pairs whose bounding boxes (over all projections)
    are farther apart and those without a probe vector.  Never a product of all blocks.  ``others``: a is a block
    of the one table, b one of the other."""
    blocks = _boxes(blocked)
    n = F.size("block.cell")
    around = F.transform(F.sequence(F.lit(0), F.pow(F.lit(3), n).cast("int") - 1), lambda k: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("block.cell"), i) + F.floor(k / F.pow(F.lit(3), i)).cast("long") % 3 - 1))
    steps = F.when(n > 0, around).otherwise(F.array("block.cell"))
    left = blocks.select(F.col("block").alias("a"), F.col("box").alias("box_a"), F.col("probe").alias("probe_a"), F.explode(steps).alias("cell"))
    right = (blocks if others is None else _boxes(others)).select(
        F.col("block").alias("b"), F.col("box").alias("box_b"), F.col("probe").alias("probe_b"), F.col("block.cell").alias("cell"))
    gap = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0))),
                      F.lit(0.0), lambda t, g: t + g * g)
    wanted = (F.col("a") <= F.col("b")) & (F.col("probe_a") | F.col("probe_b")) if others is None else F.lit(True)
    return (left.join(right, "cell").filter(wanted)
            .filter(gap <= F.lit(radius * radius * (1 + 1e-9) + 1e-18)).select("a", "b"))


def _radius(eps: float, cosine: bool) -> float:
    return math.sqrt(2.0 * eps) if cosine else float(eps)


def _blocked(df: DataFrame, radius: float, key: str, vec: str, block_rows: int | None, cosine: bool, probe: Column | None,
             cell_dims: int, box_dims: int) -> tuple[DataFrame, int]:
    """The vectors laid out in cells and blocks: ``key, v, probe, p, block``; and their number."""
    v = F.col(vec).cast("array<double>")
    t = df.select(key, (VF.l2_normalize(v) if cosine else v).alias("v"),  # zero vector -> null
                  (F.lit(True) if probe is None else F.coalesce(probe, F.lit(False))).alias("probe"))
    t = t.filter(F.col("v").isNotNull())  # a missing vector has no neighbours
    laid = _cells(t, key, max(radius, 1e-9), block_rows, cell_dims, box_dims)
    return laid.select(key, "v", "probe", "p", "block"), laid._rows


def _to_tiles(base: DataFrame, tiles: DataFrame, *columns: str) -> DataFrame:
    """Each row of ``base`` to the tiles of its block; side 0 = left, 1 = right, 2 = both."""
    same = F.col("a") == F.col("b")
    first = tiles.select(F.col("a").alias("block"), F.struct("a", "b").alias("tile"), F.when(same, 2).otherwise(0).alias("side"))
    second = tiles.filter(~same).select(F.col("b").alias("block"), F.struct("a", "b").alias("tile"), F.lit(1).alias("side"))
    return base.join(first.unionByName(second), "block").select("tile", "side", *columns)


def range_pairs(df: DataFrame, eps: float, key: str = "id", vec: str = "vec",
                block_rows: int | None = None, metric: str = "euclidean", probe: Column | None = None,
                cell_dims: int = 5, box_dims: int = 8) -> DataFrame:
    """All ordered pairs ``(src, dst, dist)`` with src != dst and dist <= eps.

    Vectors fall into cells along the leading principal directions; only neighbouring blocks
    whose boxes come within eps meet (``near_tiles``), and only vectors of such blocks are
    shipped.  ``probe`` (a boolean column): only pairs with at least one probe vector are
    formed -- new against known and new against new, never known against known.
    metric="cosine" uses 1 - cos on L2-normalised vectors (computed from the Euclidean
    distance of the unit vectors: 1 - cos = d^2 / 2)."""
    cosine = metric == "cosine"
    radius = _radius(eps, cosine)
    blocked, _ = _blocked(df, radius, key, vec, block_rows, cosine, probe, cell_dims, box_dims)
    shipped = _to_tiles(blocked, near_tiles(blocked, radius), "probe", key, "v")
    key_type = df.schema[key].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side != 1], pdf[pdf.side != 0]
        diag = bool((pdf.side == 2).any())
        found = [pd.DataFrame({"src": [], "dst": [], "dist": []})]
        # probes of either side against the whole other side, then the other side's probes
        # against the rest: every wanted pair once, no other pair at all
        if diag:
            meets = [(left[left.probe], left, True)]
        else:
            meets = [(left[left.probe], right, False), (right[right.probe], left[~left.probe], False)]
        for x, y, within in meets:
            if not len(x) or not len(y):
                continue
            ay, ky, other = np.stack(y.v.to_numpy()), y[key].to_numpy(), ~y.probe.to_numpy()
            for part in _strips(len(x), len(y)):
                kx = x[key].to_numpy()[part]
                d2 = _sqdist(np.stack(x.v.to_numpy()[part]), ay)
                dist = np.round(d2 / 2.0 if cosine else np.sqrt(d2), 12)
                hit = dist <= eps
                if within:
                    hit &= kx[:, None] != ky[None, :]
                i, j = np.nonzero(hit)
                found.append(pd.DataFrame({"src": kx[i], "dst": ky[j], "dist": dist[i, j]}))
                back = other[j] if within else np.ones(len(j), bool)
                found.append(pd.DataFrame({"src": ky[j][back], "dst": kx[i][back], "dist": dist[i, j][back]}))
        return pd.concat(found)

    return shipped.groupBy("tile").applyInPandas(kernel, f"src {key_type}, dst {key_type}, dist double")


def _strips(rows: int, others: int):
    """Slices of ``rows`` rows whose distances to ``others`` rows make about ``STRIP`` numbers."""
    step = max(1, STRIP // max(others, 1))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each key (-1: null) and the keys by number; keys stay Arrow values."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(np.unique(np.diff(v.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different lengths")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _within(d2: np.ndarray, eps: float, cosine: bool) -> np.ndarray:
    """Where the distance, rounded to 12 places, is at most ``eps``; roots are taken only close to the limit."""
    lo, hi = ((2 * x if cosine else x * abs(x)) for x in (eps - 1e-11, eps + 1e-11))
    hit = d2 <= hi
    close = np.flatnonzero(hit & (d2 > lo))
    if len(close):
        d = np.maximum(d2.ravel()[close], 0.0)
        hit.ravel()[close] = np.round(d / 2.0 if cosine else np.sqrt(d), 12) <= eps
    return hit


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (least vertex of each vertex's component) after the components a[i] and b[i] have met."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    low = np.arange(len(ids))
    while True:
        least, new = np.minimum(low[x], low[y]), low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, low):
            to = np.arange(len(root))
            to[ids] = ids[low]
            return to[root]
        low = new


def core_graphs(df: DataFrame, graphs: Sequence[tuple[float, int]], key: str = "id", vec: str = "vec",
                block_rows: int | None = None, metric: str = "euclidean", cell_dims: int = 5,
                box_dims: int = 8, first_from: int | None = None, first_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Core points ``(g, id)`` and edges ``(g, src, dst)`` of several graphs, each given as (radius, min_samples).

    A point is core in a graph when at least min_samples (and one) others are within its radius.  The
    edges are not all links between core points, but have the same components: a tile returns a spanning
    forest for each graph, and each row's numbers of neighbours, so what is written and shuffled does not
    grow with the pairs.  A graph that asks for one neighbour needs one pass, because both ends of any
    link are core; the others take a second one, with the counts of the first.  A null key counts as a
    neighbour, but is in no graph.

    A table of ``first_from`` rows is compared in groups of ``first_rows`` first (``_settled``); the points that this
    does not settle are then compared with all."""
    cosine = metric == "cosine"
    radii = sorted({float(r) for r, _ in graphs})
    step = {r: i for i, r in enumerate(radii)}
    wide = _radius(radii[-1], cosine)
    blocked, rows = _blocked(df, wide, key, vec, block_rows, cosine, None, cell_dims, box_dims)
    key_type = df.schema[key].dataType.simpleString()
    numbered = [(g, step[float(r)], ms) for g, (r, ms) in enumerate(graphs)]

    def kernel_of(some: list[tuple[int, int, int]], counted: bool, one_sided: bool = False):
        """``one_sided``: neighbours are counted for the left rows alone, which may also stand among the right."""
        def kernel(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            code, names = _codes(table.column(key))
            x = _matrix(table.column("v"))
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            diag, known = bool((side == 2).any()), code >= 0
            repeated = len(names) < len(code)
            degree = np.zeros((len(radii), len(code)), np.int64)
            root = {g: np.arange(len(names)) for g, _, _ in some}
            core = {g: known for g, _, _ in some} if counted else {
                g: known & (np.stack(table.column("degrees").to_numpy())[:, k] >= ms) for g, k, ms in some}
            length = (x * x).sum(1)
            # one product makes the squares: (x, |x|^2, 1) . (-2 y, 1, |y|^2)
            ax = np.concatenate([x[left], length[left][:, None], np.ones((len(left), 1))], axis=1)
            by = np.ascontiguousarray(np.concatenate([-2.0 * x[right], np.ones((len(right), 1)), length[right][:, None]], axis=1).T)
            for part in _strips(len(left), len(right)) if len(right) else ():
                row = left[part]
                d2 = ax[part] @ by
                if one_sided:
                    i, j = _equal(code[row], code[right])
                    d2[i, j] = np.inf
                elif diag and repeated:
                    d2[code[row][:, None] == code[right][None, :]] = np.inf
                elif diag:
                    d2[np.arange(len(row)), row] = np.inf
                for k, r in enumerate(radii):
                    mine = [g for g, at, _ in some if at == k]
                    if not counted and not mine:
                        continue
                    hit = _within(d2, r, cosine)
                    n = np.count_nonzero(hit)
                    if not n:
                        continue
                    few = n < hit.size >> 4
                    if few:
                        i, j = np.nonzero(hit)
                    if counted:
                        degree[k, row] += np.bincount(i, minlength=len(row)) if few else np.count_nonzero(hit, axis=1)
                        if not diag and not one_sided:
                            degree[k, right] += np.bincount(j, minlength=len(right)) if few else np.count_nonzero(hit, axis=0)
                    for g in mine:
                        at = root[g] if len(names) else code
                        a, b = at[code[row]], at[code[right]]
                        if few:
                            link = (a[i] != b[j]) & core[g][row[i]] & core[g][right[j]]
                            u, w = i[link], j[link]
                        else:
                            link = hit & (a[:, None] != b[None, :])
                            link[~core[g][row]] = False
                            if not core[g][right].all():
                                link[:, ~core[g][right]] = False
                            u, w = np.nonzero(link)
                        if len(u):
                            root[g] = _merge(root[g], a[u], b[w])
            out = []
            for g, at in root.items():
                v = np.flatnonzero(at != np.arange(len(at)))
                out.append((np.full(len(v), g), names.take(pa.array(v)), names.take(pa.array(at[v])), pa.nulls(len(v), pa.int64())))
            for k in range(len(radii)) if counted else ():
                n = np.bincount(code[known], degree[k, known], len(names)).astype(np.int64)
                v = np.flatnonzero(n)
                out.append((np.full(len(v), k), names.take(pa.array(v)), pa.nulls(len(v), names.type), pa.array(n[v])))
            return pa.concat_tables([pa.Table.from_arrays([pa.array(c[0].astype(np.int32)), *c[1:]], ["g", "src", "dst", "n"]) for c in out])
        return kernel

    schema = f"g int, src {key_type}, dst {key_type}, n bigint"
    once, more = [c for c in numbered if c[2] <= 1], [c for c in numbered if c[2] > 1]
    of_step = F.array(*[F.array(*[F.struct(F.lit(g).alias("g"), F.lit(max(int(ms), 1)).alias("ms")) for g, at, ms in numbered if at == k])
                        for k in range(len(radii))])
    chosen = F.filter(F.element_at(of_step, F.col("step") + 1), lambda c: c["ms"] <= F.col("n"))

    def compared(to_tiles, total, settled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Core points and edges of the tiles that ``to_tiles(with_degrees, *columns)`` makes; ``total`` joins a point's
        numbers of neighbours in them.  ``settled`` points are core in every graph and not counted."""
        one_sided = settled is not None
        found = hold(to_tiles(None, key, "v").groupBy("tile").applyInArrow(kernel_of(once, True, one_sided), schema), "near")
        degree = hold(found.filter(F.col("n").isNotNull()).groupBy(F.col("g").alias("step"), "src").agg(total("n").alias("n")), "degrees")
        core = degree.select(F.explode(chosen).alias("c"), F.col("src").alias("id")).select("c.g", "id")
        edges = found.filter(F.col("n").isNull()).select("g", "src", "dst")
        if more:
            counts = degree.groupBy(F.col("src").alias(key)).agg(F.array(*[
                F.coalesce(F.max(F.when(F.col("step") == k, F.col("n"))), F.lit(0).cast("bigint")) for k in range(len(radii))]).alias("degrees"))
            if settled is not None:
                counts = counts.unionByName(settled.withColumn("degrees", F.array(*[F.lit(1 << 62)] * len(radii))))
            found = hold(to_tiles(counts, key, "v", "degrees").groupBy("tile")  # (a point without a neighbour is no core point)
                         .applyInArrow(kernel_of(more, False, one_sided), schema), "near")
            edges = edges.unionByName(found.select("g", "src", "dst"))
        return core, edges

    def with_degrees(t: DataFrame, counts: DataFrame | None) -> DataFrame:
        return t if counts is None else t.join(counts, key)

    def in_blocks(counts: DataFrame | None, *columns: str) -> DataFrame:
        return _to_tiles(with_degrees(blocked.select(key, "v", "block"), counts), near_tiles(blocked, wide), *columns)

    if rows < (FIRST_FROM if first_from is None else first_from):
        return compared(in_blocks, F.sum)

    def in_groups(counts: DataFrame | None, *columns: str) -> DataFrame:
        """Each row in a group of near rows (of its cell) and in one of rows from everywhere."""
        size = FIRST_ROWS if first_rows is None else first_rows
        cells = blocked.groupBy("block.cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("split"))
        t = blocked.select(key, "v", F.col("block.cell").alias("cell")).join(cells, "cell")
        near = F.struct("cell", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.col("split").cast("long")).alias("sub"))
        wide_of = F.struct(F.lit(None).cast("array<bigint>").alias("cell"), F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(-(-rows // size)).cast("long")).alias("sub"))
        t = with_degrees(t.select(key, "v", F.array(near, wide_of).alias("tiles")), counts)
        return t.withColumn("tile", F.explode("tiles")).select("tile", F.lit(2).alias("side"), *columns)

    # (two groups may hold the same pair: the larger of their counts is certain, their sum is not)
    settled, stars = _settled(*compared(in_groups, F.max), len(graphs), key)
    rest = hold(blocked.filter(F.col(key).isNotNull()).join(settled, key, "left_anti"), "rest")
    left_over = rest.count()
    if 2 * left_over > rows:
        return compared(in_blocks, F.sum)
    per_block = block_size(rows, block_rows)
    few = rest.groupBy("block.cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_block)).cast("long").alias("split"))
    probes = (rest.withColumn("cell", F.col("block.cell")).join(few, "cell")
              .withColumn("block", F.struct("cell", F.pmod(F.xxhash64(F.col(key)), F.col("split")).alias("sub"))).select(key, "v", "probe", "p", "block"))

    def against_all(counts: DataFrame | None, *columns: str) -> DataFrame:
        tiles = near_tiles(probes, wide, blocked)
        tile = F.struct("a", "b").alias("tile")
        one = with_degrees(probes.select(key, "v", "block"), counts).join(tiles.select(F.col("a").alias("block"), tile), "block")
        two = with_degrees(blocked.select(key, "v", "block"), counts).join(tiles.select(F.col("b").alias("block"), tile), "block")
        return one.select("tile", F.lit(0).alias("side"), *columns).unionByName(two.select("tile", F.lit(1).alias("side"), *columns))

    core, edges = compared(against_all, F.sum, settled)
    sure = settled.select(F.explode(F.sequence(F.lit(0), F.lit(len(graphs) - 1))).alias("g"), F.col(key).alias("id"))
    return core.unionByName(sure), edges.unionByName(stars)


def _settled(core: DataFrame, edges: DataFrame, graphs: int, key: str) -> tuple[DataFrame, DataFrame]:
    """``(key)`` of the points that are core and in the largest component in every one of the ``graphs``, by the
    core points and edges found so far, and those components as edges to their least points."""
    from tessera.operators import graph

    vertex = lambda c: F.struct("g", F.col(c).alias("p"))
    comp = graph.connected_components(core.select(vertex("id").alias("id")), edges.select(vertex("src").alias("src"), vertex("dst").alias("dst")))
    comp = comp.select(F.col("id.g").alias("g"), F.col("id.p").alias("src"), F.col("comp.p").alias("dst"))
    largest = comp.groupBy("g", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max(F.struct("n", "dst")).alias("m"))
    inside = comp.join(F.broadcast(largest.select("g", F.col("m.dst").alias("dst"))), ["g", "dst"])  # (one row a graph)
    settled = hold(inside.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == graphs).select(key), "settled")
    return settled, comp.filter(F.col("src") != F.col("dst"))


def nearest_known(df: DataFrame, eps: float, known: str, key: str = "id", vec: str = "vec",
                  block_rows: int | None = None, cell_dims: int = 5, box_dims: int = 8) -> DataFrame:
    """``(src, dst, dist)``: the nearest row with ``known`` within ``eps`` of each row without (ties: lower key).
    A tile returns one candidate a row, never its pairs."""
    radius = float(eps)
    blocked, _ = _blocked(df.filter(F.col(key).isNotNull()), radius, key, vec, block_rows, False, ~F.col(known), cell_dims, box_dims)
    tiles = near_tiles(blocked, radius)
    key_type = df.schema[key].dataType.simpleString()

    def kernel(table: pa.Table) -> pa.Table:
        side, probe = table.column("side").to_numpy(), table.column("probe").to_numpy()
        code, names = _codes(table.column(key))
        x = _matrix(table.column("v"))
        rank = np.argsort(pc.sort_indices(names).to_numpy(zero_copy_only=False))
        length, out = (x * x).sum(1), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for one, two in ((2, 2),) if (side == 2).any() else ((0, 1), (1, 0)):
            rows, others = np.flatnonzero((side == one) & probe), np.flatnonzero((side == two) & ~probe)
            others = others[np.argsort(rank[code[others]], kind="stable")]
            for part in _strips(len(rows), len(others)) if len(others) else ():
                row = rows[part]
                dist = np.round(np.sqrt(np.maximum(length[row][:, None] + length[others][None, :] - 2.0 * (x[row] @ x[others].T), 0.0)), 12)
                dist[~(dist <= radius)] = np.inf
                j = dist.argmin(1)
                d = dist[np.arange(len(row)), j]
                ok = np.isfinite(d)
                out.append((code[row[ok]], code[others[j[ok]]], d[ok]))
        src, dst, d = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([names.take(pa.array(src)), names.take(pa.array(dst)), pa.array(d)], ["src", "dst", "dist"])

    found = (_to_tiles(blocked, tiles, "probe", key, "v").groupBy("tile")
             .applyInArrow(kernel, f"src {key_type}, dst {key_type}, dist double"))
    return found.groupBy("src").agg(F.min(F.struct("dist", "dst")).alias("m")).select("src", "m.dst", "m.dist")


def _k_least(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of each row's ``k`` least distances, from their squares; distances equal to 12
    digits go by the lower column.  Only what the k-th least square lets through is rooted, rounded and sorted."""
    d2 = np.where(np.isnan(d2), np.inf, d2)
    m = min(k, d2.shape[1])
    last = np.partition(d2, m - 1, axis=1)[:, m - 1]
    row, col = np.nonzero(d2 <= ((np.sqrt(last) + 1e-11) ** 2)[:, None])
    dist = np.round(np.sqrt(d2[row, col]), 12)
    order = np.lexsort((col, dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = (np.arange(len(row)) - np.searchsorted(row, row) < m) & np.isfinite(dist)
    return row[keep], col[keep], dist[keep]


def _k_first(row, col, dist, k: int, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of each row's pairs by distance, then column (or ``order`` of the pairs)."""
    at = np.lexsort((col if order is None else order, dist, row))
    row, col, dist = row[at], col[at], dist[at]
    keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(dist)
    return row[keep], col[keep], dist[keep]


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` with a[i] == b[j]."""
    some = np.flatnonzero(np.isin(b, a))
    i, j = np.nonzero(a[:, None] == b[some][None, :])
    return i, some[j]


def knn(df: DataFrame, k: int, key: str = "id", vec: str = "vec", block_rows: int | None = None,
        width: float | None = None) -> DataFrame:
    """Exact k nearest other vectors per vector: ``(src, dst, dist, rank)``.

    Pass 1 scores each block against itself; the k-th distance found bounds
    each block's search radius.  Pass 2 forms only the tiles within that
    radius (ring pruning) and keeps each row's k best per tile; a final
    ``row_number() <= k`` (partial WindowGroupLimit) merges them.  Blocks grow with the table
    (``block_size``) and are compared some rows at a time.
    Ties are broken by the neighbour key."""
    if width is None:
        width = 0.25
    df = df.filter(F.col(vec).isNotNull())
    # the layout feeds both passes and the bounds: store it once
    blocked = hold(_with_blocks(df, key, vec, width, block_size(0 if block_rows else df.count(), block_rows)), "blocks")
    blocks = _blocks(blocked)
    key_type = df.schema[key].dataType.simpleString()
    kk = int(k)

    def topk(table: pa.Table) -> pa.Table:
        """Each row's k best of a tile, for the rows of either side; of the rows that have a bound only what is within it."""
        side = table.column("side").to_numpy()
        x = _matrix(table.column("v"))
        code, names = _codes(table.column(key))
        bound = table.column("u").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False) if "u" in table.column_names else np.full(len(side), np.inf)
        limit = (bound + 1e-11) ** 2
        rank = np.empty(len(names) + 1, np.int64)
        rank[pc.sort_indices(names).to_numpy(zero_copy_only=False)] = np.arange(len(names))
        rank[-1] = len(names)  # (a null key comes last)
        # both sides in key order: equal distances go by the lower key
        diag = bool((side == 2).any())
        left, right = (at[np.argsort(rank[code[at]], kind="stable")] for at in (np.flatnonzero(side != 1), np.flatnonzero(side != 0)))
        length, found = (x * x).sum(1), []
        ax = np.concatenate([x[left], length[left][:, None], np.ones((len(left), 1))], axis=1)
        by = np.ascontiguousarray(np.concatenate([-2.0 * x[right], np.ones((len(right), 1)), length[right][:, None]], axis=1).T)
        for part in _strips(len(left), len(right)) if len(right) else ():
            row = left[part]
            d2 = ax[part] @ by
            if diag:
                i, j = _equal(code[row], np.where(code[right] < 0, -2, code[right]))  # (null keys are not one row)
                d2[i, j] = np.inf
            for mine, others, turned in ((row, right, False),) if diag else ((row, right, False), (right, row, True)):
                most = limit[mine]
                if np.isfinite(most).all():
                    i, j = np.nonzero(d2 <= (most[None, :] if turned else most[:, None]))
                    dist = np.round(np.sqrt(np.maximum(d2[i, j], 0.0)), 12)
                    i, j, dist = _k_first(*((j, i) if turned else (i, j)), dist, kk)
                else:
                    i, j, dist = _k_least(np.maximum(d2.T if turned else d2, 0.0), kk)
                found.append((mine[i], others[j], dist))
        src, dst, dist = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(src):  # (the right rows have met the left ones strip by strip)
            src, dst, dist = _k_first(src, dst, dist, kk, rank[code[dst]])
        null = lambda c: pa.array(code[c], mask=code[c] < 0)
        return pa.Table.from_arrays([names.take(null(src)), names.take(null(dst)), pa.array(dist)], ["src", "dst", "dist"])

    schema = f"src {key_type}, dst {key_type}, dist double"
    # pass 1: within-block bound
    diag_tiles = blocks.select(F.col("ring").alias("r1"), F.col("sub").alias("s1"),
                               F.col("ring").alias("r2"), F.col("sub").alias("s2"))
    first = _ship(blocked, diag_tiles, key, vec).groupBy("tile").applyInArrow(topk, schema)
    kth = hold(first.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("u"))
               .select("src", F.when(F.col("c") >= kk, F.col("u")).alias("u")), "kth")
    with_u = blocked.join(kth.withColumnRenamed("src", key), key, "left")
    bound = with_u.groupBy("ring", "sub").agg(F.max("u").alias("U"), F.count("u").alias("nu"), F.count(F.lit(1)).alias("n"))
    max_ring = blocked.agg(F.max("ring") - F.min("ring")).scalar()
    reach = F.when(F.col("nu") == F.col("n"), F.ceil(F.col("U") / F.lit(width)).cast("long") + 1).otherwise(max_ring)
    reach_tbl = bound.select("ring", "sub", reach.alias("g"))
    # pass 2: tiles within reach of either block (symmetric); a row's own bound travels with it
    tiles = _tiles_within(reach_tbl)
    cand = _ship(with_u, tiles, key, vec, "u").groupBy("tile").applyInArrow(topk, schema)
    w = Window.partitionBy("src").orderBy(F.col("dist").asc(), F.col("dst").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kk)


def _single_ring_blocks(df: DataFrame, key: str, block_rows: int | None) -> DataFrame:
    n = df.agg(F.count(F.lit(1))).scalar()
    rows = F.lit(block_rows) if block_rows else F.greatest(F.lit(BLOCK_ROWS), F.least(F.ceil(n / F.lit(BLOCKS)), F.lit(MAX_BLOCK_ROWS)))
    nsub = F.greatest(F.ceil(n / rows), F.lit(1)).cast("long")
    return df.withColumn("ring", F.lit(0).cast("long")).withColumn("sub", F.pmod(F.xxhash64(F.col(key)), nsub))


def search_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "id", vec: str = "vec",
                block_rows: int = BLOCK_ROWS, metric: str = "cosine") -> DataFrame:
    """Best ``k`` corpus rows per query row: ``(query, match, score, rank)``.

    score = cosine similarity (metric="cosine") or -distance.  The corpus is
    split into bounded blocks; every query row is sent to every block (the
    query set is the small side), each block keeps its k best per query, and
    a ``row_number() <= k`` merges them.  Ties: lower match key first."""
    corpus = corpus.filter(F.col(vec).isNotNull())
    queries = queries.filter(F.col(vec).isNotNull())
    cb = _single_ring_blocks(corpus.select(key, vec), key, block_rows)
    q = queries.select(F.col(key).alias("q"), F.col(vec).cast("array<double>").alias("v"))
    # tiles = (query block, corpus block); both sides are bounded blocks, so a
    # query set holding a third of all rows is split like the corpus.  Each
    # query row goes to every corpus block and each corpus row to every query
    # block (explode of dense block ids, no join).
    nblocks = cb.agg(F.max("sub") + 1).scalar()
    nq = q.agg(F.count(F.lit(1))).scalar()
    nqblocks = F.greatest(F.ceil(nq / F.lit(block_rows)), F.lit(1)).cast("long")
    qb = q.withColumn("qsub", F.pmod(F.xxhash64(F.col("q")), nqblocks))
    left = (qb.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), nblocks - 1)))
            .select("qsub", "sub", F.lit(0).alias("side"), F.col("q").alias("k"), "v"))
    right = (cb.withColumn("qsub", F.explode(F.sequence(F.lit(0).cast("long"), nqblocks - 1)))
             .select("qsub", "sub", F.lit(1).alias("side"), F.col(key).alias("k"),
                     F.col(vec).cast("array<double>").alias("v")))
    key_type = corpus.schema[key].dataType.simpleString()
    qtype = queries.schema[key].dataType.simpleString()
    kk = int(k)
    cos = metric == "cosine"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf.side == 0]
        R = pdf[pdf.side == 1]
        if len(L) == 0 or len(R) == 0:
            return pd.DataFrame({"query": [], "match": [], "score": []})
        a = np.stack(L.v.to_numpy())
        b = np.stack(R.v.to_numpy())
        if cos:
            na = np.linalg.norm(a, axis=1)[:, None]
            nb = np.linalg.norm(b, axis=1)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (a @ b.T) / (na * nb)
        else:
            s = -np.sqrt(_sqdist(a, b))
        s = np.round(np.nan_to_num(s, nan=-np.inf), 12)
        bk = R.k.to_numpy()
        order = np.argsort(bk, kind="stable")
        s, bk = s[:, order], bk[order]
        m = min(kk, len(bk))
        idx = np.argsort(-s, axis=1, kind="stable")[:, :m]
        return pd.DataFrame({"query": np.repeat(L.k.to_numpy(), m), "match": bk[idx].ravel(),
                             "score": np.take_along_axis(s, idx, 1).ravel()})

    cand = left.unionByName(right).groupBy("qsub", "sub").applyInPandas(
        kernel, f"query {qtype}, match {key_type}, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("match").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kk)


def cluster_distance_sums(df: DataFrame, key: str = "id", vec: str = "vec", label: str = "cluster",
                          metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """For every point and every cluster: sum and count of distances to that
    cluster's points, ``(key, cluster, dsum, cnt)`` (the point itself counts
    with distance 0).  All block pairs are scored in numpy, some rows at a time; per tile only
    point x cluster partial sums leave the task.  Blocks grow with the table (``block_size``), so that
    a vector is shipped to about ``BLOCKS`` tiles."""
    blocked = _single_ring_blocks(df.select(key, vec, label).filter(F.col(vec).isNotNull()), key, block_rows)
    # sub-block ids are dense (pmod), so the tiles (s1 <= s2) are an explode
    # of each block's id range -- no join (and no cross product) at all
    nsub = blocked.agg(F.max("sub") + 1).scalar()
    tiles = (blocked.select(F.col("sub").alias("s1")).distinct()
             .withColumn("s2", F.explode(F.sequence(F.col("s1"), nsub - 1))))
    t = tiles.withColumn("tile", F.struct("s1", "s2"))
    diag = (F.col("s1") == F.col("s2"))
    base = blocked.select(key, F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("lab"), "sub")
    as_left = base.join(t.select(F.col("s1").alias("sub"), "tile", F.when(diag, 2).otherwise(0).alias("side")), "sub")
    as_right = base.join(t.filter(~diag).select(F.col("s2").alias("sub"), "tile", F.lit(1).alias("side")), "sub")
    shipped = as_left.unionByName(as_right).select("tile", "side", key, "v", "lab")
    key_type = df.schema[key].dataType.simpleString()
    cos = metric == "cosine"

    def dist(a, b):
        if cos:
            na = np.linalg.norm(a, axis=1)[:, None]
            nb = np.linalg.norm(b, axis=1)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                return 1.0 - np.nan_to_num((a @ b.T) / (na * nb))
        return np.sqrt(_sqdist(a, b))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf.side != 1]
        R = pdf[pdf.side != 0]
        diag_t = bool((pdf.side == 2).any())
        outs = []
        pairs_ = [(L, R)] if diag_t else [(L, R), (R, L)]
        for A, B in pairs_:
            if len(A) == 0 or len(B) == 0:
                continue
            labs, inv = np.unique(B.lab.to_numpy(), return_inverse=True)
            onehot = np.zeros((len(B), len(labs)))
            onehot[np.arange(len(B)), inv] = 1.0
            a, b, sums = np.stack(A.v.to_numpy()), np.stack(B.v.to_numpy()), np.empty((len(A), len(labs)))
            for part in _strips(len(A), len(B)):
                D = dist(a[part], b)
                if diag_t:
                    at = np.arange(len(D))
                    D[at, at + part.start] = 0.0
                sums[part] = D @ onehot
            cnts = np.broadcast_to(onehot.sum(0), sums.shape)
            outs.append(pd.DataFrame({"id": np.repeat(A[key].to_numpy(), len(labs)),
                                      "cluster": np.tile(labs, len(A)),
                                      "dsum": sums.ravel(), "cnt": cnts.ravel().astype("int64")}))
        if not outs:
            return pd.DataFrame({"id": [], "cluster": [], "dsum": [], "cnt": []})
        return pd.concat(outs)

    lab_type = df.schema[label].dataType.simpleString()
    part = shipped.groupBy("tile").applyInPandas(kernel, f"id {key_type}, cluster {lab_type}, dsum double, cnt long")
    return (part.groupBy(F.col("id").alias(key), "cluster")
            .agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt")))
