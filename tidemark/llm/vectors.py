"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, materialize
from tidemark.llm.graph import connected_components

SEED = 11
#: Half the width of the query-centred windows, and the width of the cells that the cutting projections make.
WINDOW, CELL = 0.4, 1.0
#: A pair is verified if it collides in as many projections as this share of linked pairs does.
RECALL = 0.995
#: A pair at the limit meets in one of the sorted lists with at least this probability.
MEET = 0.995
#: Vectors of a cell, about, that the number of cutting projections aims at where vectors are spread out.
SPREAD = 800
#: Rows of a block; longer cells are compared block by block, each two blocks in a group of their own.
BLOCK = 1024
#: Pairs looked at at once.
CHUNK = 200_000


@dataclass(frozen=True)
class Plan:
    """``lists`` sorted projections; a list's windows slide within the cells that ``cuts`` further projections make."""

    lists: int
    cuts: int
    least: int
    cosine: float

    @property
    def sorting(self) -> np.ndarray:
        """Places of the projections that sort the lists."""
        return np.arange(self.lists) * (self.cuts + 1) + self.cuts

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng((SEED, dim))
        return rng.normal(size=(dim, self.lists * (self.cuts + 1))), rng.uniform(0, CELL, self.lists * self.cuts)

    def cells(self, values: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """(rows, lists, cuts) cells of the projected ``values``."""
        cut = values.reshape(len(values), self.lists, self.cuts + 1)[:, :, : self.cuts]
        return np.floor((cut + shift.reshape(self.lists, self.cuts)) / CELL).astype(np.int64)


def make_plan(n: int, cosine: float) -> Plan:
    """The cuts that ``n`` spread-out unit vectors need, the lists that a pair at the limit needs to meet, and the count to verify from.

    A projection of a unit vector is about normal, and that of a pair's difference normal with the pair's
    distance. ``least`` is the largest number of collisions that a pair at the limit reaches with probability
    RECALL, all projections being independent.
    """
    erf = math.erf
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    grid = np.linspace(-5, 5, 2001)
    share = float(np.exp(-(grid**2)).sum() * 0.005 / (2 * math.pi) * CELL)  # of vectors in one cell of a cut
    cuts = max(1, round(math.log(max(n, 1) / SPREAD) / -math.log(share))) if n > SPREAD else 1
    if distance:
        d = np.linspace(0, CELL, 2001)
        inside = float(((1 - d / CELL) * np.exp(-0.5 * (d / distance) ** 2)).sum() * (d[1] - d[0]) * 2 / (distance * math.sqrt(2 * math.pi)))
        near = erf(WINDOW / distance / math.sqrt(2))
        lists = max(2, math.ceil(math.log(1 - MEET) / math.log(1 - inside**cuts * near)))
    else:
        near, lists = 1.0, 2
    total, below = lists * (cuts + 1), 0.0
    for m in range(total + 1 if near < 1 else 0):
        below += math.exp(math.lgamma(total + 1) - math.lgamma(m + 1) - math.lgamma(total - m + 1) + m * math.log(near) + (total - m) * math.log1p(-near))
        if below > 1 - RECALL:
            return Plan(lists, cuts, m, cosine)
    return Plan(lists, cuts, total, cosine)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column without nulls, as views."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def _units(vecs: list[np.ndarray]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square is too large or too small."""
    x = np.array(vecs, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _links(unit: np.ndarray, at_list: int, first: np.ndarray | None, plan: Plan):
    """Pairs (i < j) of one block or, given ``first``, of two, that meet first in this list and are linked.

    A window around each vector of the sorted list proposes pairs; their collisions are counted over all
    projections, and pairs with enough of them are verified.
    """
    n = len(unit)
    matrix, shift = plan.projections(unit.shape[1])
    values = unit @ matrix
    cells = plan.cells(values, shift)
    key = values[:, plan.sorting[at_list]]
    order = np.argsort(key, kind="stable")
    upto = np.searchsorted(key[order], key[order] + WINDOW, side="right")
    reach = upto - np.arange(n) - 1
    row, most = 0, values.shape[1] * 2 // 3
    while row < n:
        stop = row + max(1, int(np.searchsorted(np.cumsum(reach[row:]), CHUNK, side="right")))
        size = reach[row:stop]
        a = np.repeat(np.arange(row, stop), size)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        a, b, row = order[a], order[b], stop
        if first is not None:
            other = first[a] != first[b]
            a, b = a[other], b[other]
        near = np.abs(values[a, :most] - values[b, :most]) <= WINDOW
        some = near.sum(1) >= plan.least - (values.shape[1] - most)  # the others can't reach the count
        a, b = a[some], b[some]
        near = np.abs(values[a] - values[b]) <= WINDOW
        some = near.sum(1) >= plan.least
        a, b, near = a[some], b[some], near[some]
        if at_list:  # pairs that an earlier list has brought together are counted there
            met = (cells[a, :at_list] == cells[b, :at_list]).all(2) & near[:, plan.sorting[:at_list]]
            a, b = a[~met.any(1)], b[~met.any(1)]
        linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.cosine
        yield a[linked], b[linked]


def _compare(ids: np.ndarray, copies: np.ndarray, mine: np.ndarray | None, unit: np.ndarray, at_list: int, plan: Plan):
    """(ids, n_links, roots) of a block's vectors that have links; a root is the smallest id linked to in the block, or the own one.

    Given ``mine``, their blocks, the vectors of two blocks are compared with each other.
    """
    count, root = np.zeros(len(ids), np.int64), ids.copy()
    pairs = list(_links(unit, at_list, mine, plan))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int), np.empty(0, int))
    np.add.at(count, a, copies[b])
    np.add.at(count, b, copies[a])
    while len(a):
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        if (root == old).all():
            break
    got = count > 0
    return ids[got], count[got], root[got]


def vector_groups(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``rows``.

    Vectors link at a cosine of at least ``cosine``, in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and vectors of different lengths don't link. Equal
    vectors link (rows with equal ids too, each counted); they enter the search as one. A row with a null id
    is counted but names no component; alone, its component is null and it is kept.

    Many projections are sorted, each within cells that a few further ones cut, since a window of one
    projection alone holds a fixed share of all vectors. Pairs in a window around each vector count their
    collisions over all projections; those that reach the calibrated count are verified exactly, in the first
    list where they meet. ``make_plan`` sets the numbers by that of the vectors, for the same recall at any
    size; see the README for the recall measured. Cells of more than BLOCK rows are compared block by block.

    Ids and cells alone are laid out, sized and thinned to the cells of two vectors or more. Each vector is then
    fetched once, and goes to each of its cells in one shuffle, in single precision where that is its own.
    """
    scratch = Scratch(rows.sparkSession)
    own = rows.select(vec_col).schema[0].dataType
    width = "float" if own == T.ArrayType(T.FloatType(), own.containsNull) else "double"
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{width}>").alias("vec"))
    usable = F.coalesce(F.expr("vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vec, x -> x <> 0)"), F.lit(False))
    good = plain.filter(usable)
    same = good.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    same = scratch.keep(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    plan = make_plan(same.count(), cosine)

    def place(batches):
        for b in batches:
            vecs = _vectors(b.column(1))
            for dim in sorted({len(v) for v in vecs}):
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                matrix, shift = plan.projections(dim)
                cells, reps = plan.cells(_units([vecs[i] for i in at]) @ matrix, shift), b.column(0).take(pa.array(at))
                for t in range(plan.lists):
                    key = [f"{dim}|{t}|" + ",".join(map(str, c)) for c in cells[:, t].tolist()]
                    yield pa.RecordBatch.from_arrays([reps, pa.array(key)], ["rep", "cell"])

    placed = scratch.keep(same.select("rep", "vec").mapInArrow(place, "rep long, cell string"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    sized = placed.join(sizes, "cell").select("rep", F.struct("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")).alias("at"))
    visits = sized.groupBy("rep").agg(F.collect_list("at").alias("visits"))  # one a list at most
    sent = same.join(visits, "rep").select("rep", "copies", "vec", F.explode("visits").alias("at")).select("rep", "copies", "vec", "at.*")
    parted = sent.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("parts")).cast("int"))
    tiled = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "copies", "vec"
    )

    def search(batches):
        held, key = [], None

        def done():
            if len(held) > 1:
                part, ids, copies, vecs = zip(*held, strict=True)
                cell, lo, hi = key
                ids, count, root = _compare(np.array(ids), np.array(copies), np.array(part) if lo != hi else None, _units(vecs), int(cell.split("|")[1]), plan)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(root)], ["id", "n", "root"])

        for b in batches:
            vecs = _vectors(b.column("vec"))
            for *k, part, rep, copies, vec in zip(*(b.column(c).to_pylist() for c in ("cell", "lo", "hi", "part", "rep", "copies")), vecs, strict=True):
                if k != key:
                    yield from done()
                    held, key = [], k
                held.append((part, rep, copies, vec))
        yield from done()

    found = scratch.keep(
        tiled.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(search, "id long, n long, root long"), "found"
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    merged = same.select("vec", "rep", "least", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    merged = scratch.keep(merged, "merged")
    named = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    names = merged.join(named, "root").select("vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    # rows without a usable vector need no partner, so that the only hot keys are vectors that very many rows have, whose partitions Spark splits
    linked = good.join(names, "vec").select("id", "n_links", "component_id")
    useless = plain.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", F.coalesce("component_id", "id").alias("component_id")).union(useless).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
    out = materialize(out, "vector_groups")
    scratch.drop()
    return out
