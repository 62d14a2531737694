"""Near copies by the Jaccard similarity of word shingles: op10's method with fingerprints that grow with the text, for the pipeline.

64-bit fingerprints of texts at the limit of 0.8 differ in about 10 bits, where cells of bit counts no longer
tell texts apart (README). So the space of the shingles' hashes is cut into parts, as many as the text has
shingles (to a power of two), and each part has a 64-bit SimHash of its own, the majority of the hashes in it.
A shingle that only one of two texts has changes one part, so texts within the limit agree in a known number
of parts. The bit counts of a part's segments are its cell, and cells join by equality (a Manhattan distance of
zero there). Pairs of a cell are held to the Manhattan distance of their counts over the whole hash space, which
is a lower bound of the sets' difference; pairs within the bound are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialize
from tidemark.llm.graph import connected_components
from tidemark.llm.simhash import LOW, embedded, majority

#: Up to so many members of a posting (the documents of a cell) make all pairs; larger ones first link to so many pivots.
FEW, PIVOTS = 8, 3
#: Members of a block; larger postings are compared block by block, each two blocks (a tile) in a group of their own.
BLOCK = 512
#: Shingles of a set on average, if a block has so many members; blocks of larger sets have fewer, as a task holds the sets of a tile.
LONG = 4096
#: Postings of a member that tell in which one a pair was compared already: so many, the first ones. Whole lists would take the square of a text's cells.
TOLD = 32
#: Words of embeddings that are compared at once.
CHUNK = 4_000_000
#: Hashes of texts whose cells are made at once.
TOGETHER = 100_000
#: Words whose hashes a task remembers; the memory starts anew beyond.
REMEMBER = 400_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 5)
        return out


def shingles(text: bytes, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes (unsigned) of the shingles of ``words`` words, lower-cased (A-Z); a shorter text is one shingle, a blank one has none."""
    tokens = text.lower().split()
    n, k = len(tokens), min(words, len(tokens))
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ each[i : n - k + 1 + i]) * np.uint64(_MIX[1])
            out ^= out >> np.uint64(29)
            out = out * np.uint64(_MIX[0]) + np.uint64(_MIX[2])
        out ^= out >> np.uint64(32)
    return np.unique(out)


def counts(s: np.ndarray) -> np.ndarray:
    """Counts (0 to 2, which stands for more, too) of a set of n hashes in n to 2n segments of the hash space, 32 at least.

    They are written as thermometer bits like ``simhash.embed``, 32 segments a word, so that the number of
    differing bits is the Manhattan distance. A hash that one set has alone adds one at most, so the distance
    is a lower bound of the sets' difference.
    """
    size = 1 << max(5, len(s).bit_length())
    n = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(np.stack((n > 0, n > 1), axis=1).ravel(), bitorder="little").view(np.int64)


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two ``counts``; the counts of the longer are added up to the length of the other."""
    half = lambda x: (F.size(x) / 2).cast("int")
    add = lambda p, q: p.bitwiseOR(q).bitwiseOR(F.shiftleft(p.bitwiseAND(q).bitwiseAND(F.lit(LOW)), 1))
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), add)
    x = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, d: t + d)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def grids(n: int) -> list[tuple[int, int]]:
    """(grid, most): the grids that a set of n hashes enters, and the hashes that it and an alike set there have not in common, at most.

    Grid c is for pairs whose smaller set has 2^c to 2^(c+1) - 1 hashes. Alike sets differ in a ninth of their
    sizes' sum at most, which is a quarter of the smaller size at most.
    """
    c = n.bit_length() - 1
    below = 2**c - 1
    return [(c, n // 4), *([(c - 1, (n + below) // 9)] if 4 * n <= 5 * below else [])]


def cells(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The cells of each set of hashes (sorted, unsigned): any two alike sets share one.

    A grid c has 2^c parts, each with the SimHash of a set's hashes there. The cell of a part is its number, its
    size and the bit counts of its SimHash. If two sets differ in d hashes at most, all but d of either's
    parts that aren't empty are the same, so the first d + 1 of either have one in common, in an order that is
    the same for all sets: by size, the largest first, as parts of several hashes are rarely shared by chance.
    A set with no more than d such parts gives all of them. It can miss only another set of that kind, so these
    enter the grid once more, with each hash as a part of its own.
    """
    first, size, salt, many = [], [], [], []
    at = 0
    for s in sets:
        before = len(first)
        for grid, most in grids(len(s)) if len(s) else ():
            parts = s >> np.uint64(1) >> np.uint64(63 - grid)
            start = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
            rooms = [(parts, start, grid)]
            if len(start) <= most:
                rooms.append((s, np.arange(len(s)), grid + 64))
            for part, start, name in rooms:
                n = np.diff(start, append=len(s))
                pick = np.argsort(-n, kind="stable")[: most + 1]
                first.append(start[pick] + at)
                size.append(n[pick])
                salt.append(part[start[pick]] ^ np.uint64(name * _MIX[0] % 2**64))
        many.append(sum(map(len, first[before:])))
        at += len(s)
    if not first:
        return [np.empty(0, np.uint64) for _ in sets]
    hashes, first, size, salt = (np.concatenate(x) for x in (sets, first, size, salt))
    marks = np.empty(len(first), np.uint64)
    for k in np.unique(size).tolist():
        here = size == k
        marks[here] = embedded(majority(hashes[first[here][:, None] + np.arange(k)]))
    return np.split(_mixed(marks ^ _mixed(_mixed(salt) ^ size.astype(np.uint64))), np.cumsum(many)[:-1])


def open_members(rows: list[dict]) -> list[dict]:
    """The members of a tile that have a pair to compare there: of two roots, of alike sizes and without an earlier posting in both ``own``.

    ``own`` has postings (arrays) of a member, not all of them. In the first of the postings that two members share, no earlier
    one is in both, so each pair is open in a tile. Copies of long texts share thousands, of which few tiles stay open.
    """
    this = rows[0]["s"]
    n, root, part = (np.array([r[c] for r in rows]) for c in ("n", "root", "part"))
    lists = [r["own"][r["own"] < this] for r in rows]
    _, at, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = many > 1
    place = np.cumsum(shared) - 1
    earlier = np.zeros((len(rows), int(shared.sum())), np.float32)
    member = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    earlier[member[shared[at]], place[at[shared[at]]]] = 1
    left = (root[:, None] != root) & (5 * np.minimum(n[:, None], n) >= 4 * np.maximum(n[:, None], n)) & (earlier @ earlier.T == 0)
    if rows[0]["lo"] != rows[0]["hi"]:
        left &= part[:, None] != part
    return [rows[i] for i in np.flatnonzero(left.any(axis=1)).tolist()]


def near_pairs(rows: list[dict]):
    """(position, position) in ``rows`` of the members of a block, or of two, whose roots differ and whose counts are within the bound.

    Pairs that share several postings don't come out where an earlier one of them is in both ``own``, as in ``open_members``.
    """
    this = rows[0]["s"]
    by_size: dict[int, list[int]] = {}
    for at, r in enumerate(rows):
        by_size.setdefault(len(r["counts"]), []).append(at)
    of = {k: (np.array(v), *(np.array([rows[at][c] for at in v]) for c in ("row", "n", "root", "part")), np.array([rows[at]["counts"] for at in v]).view(np.uint64)) for k, v in by_size.items()}
    postings = {k: [frozenset(rows[at]["own"]) for at in v] for k, v in by_size.items()}
    two = rows[0]["lo"] != rows[0]["hi"]
    for k, (place, row, n, root, part, bits) in of.items():
        for other in {k, 2 * k} & of.keys():  # alike sets differ in size by a fifth at most
            place_b, row_b, n_b, root_b, part_b, bits_b = of[other]
            if other > k:
                p, q = bits_b[:, :k], bits_b[:, k:]
                bits_b = p | q | ((p & q & np.uint64(LOW)) << np.uint64(1))
            step = max(1, CHUNK // (len(row_b) * k))
            for at in range(0, len(row), step):
                here = slice(at, at + step)
                apart = np.bitwise_count(bits[here, None] ^ bits_b[None]).sum(2, dtype=np.int64)
                near = (9 * apart <= n[here, None] + n_b[None]) & (root[here, None] != root_b[None])
                near &= 5 * np.minimum(n[here, None], n_b[None]) >= 4 * np.maximum(n[here, None], n_b[None])
                if two:
                    near &= part[here, None] != part_b[None]
                if other == k:
                    near &= row[here, None] < row_b[None]
                i, j = np.nonzero(near)
                first = [min(postings[k][a] & postings[other][b], default=this) >= this for a, b in zip((i + at).tolist(), j.tolist(), strict=True)]
                yield place[i[first] + at], place_b[j[first]]


def near_members(rows: list[dict]) -> list[dict]:
    """The members of a tile that are in any of its ``near_pairs``, once each, however many pairs they are in."""
    found = np.zeros(len(rows), bool)
    for i, j in near_pairs(rows):
        found[i] = found[j] = True
    return [rows[at] for at in np.flatnonzero(found).tolist()]


def near_links(rows: list[dict]) -> list[tuple[int, int]]:
    """(row, row): verified links of a tile's members that join their roots as all links of its ``near_pairs`` do, fewer than members.

    ``set`` of a member has its sorted shingles. A pair that links already join isn't verified.
    """
    above: dict[int, int] = {}
    links = []

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    rows = [r | {"counts": counts(r["set"].view(np.uint64))} for r in rows]
    for i, j in near_pairs(rows):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = rows[a], rows[b]
            p, q = top(a["root"]), top(b["root"])
            if p != q and 9 * len(np.intersect1d(a["set"], b["set"], assume_unique=True)) >= 4 * (len(a["set"]) + len(b["set"])):
                above[p] = q
                links.append((min(a["row"], b["row"]), max(a["row"], b["row"])))
    return links


def _tiles(batches, wide: str):
    """The members of each tile, whose rows follow each other; column ``wide`` (lists of longs) gives arrays."""
    held, key = [], None
    for b in batches:
        lists = b.column(wide)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        arrays = np.split(lists.flatten().to_numpy(), ends[:-1]) if b.num_rows else []
        for r, x in zip(b.select([c for c in b.schema.names if c != wide]).to_pylist(), arrays, strict=True):
            if (k := (r["s"], r["lo"], r["hi"])) != key:
                if len(held) > 1:
                    yield held
                held, key = [], k
            held.append(r | {wide: x})
    if len(held) > 1:
        yield held


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """(row, s): the shingles of each text of (row, text)."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            sets = [shingles(t.as_py() or b"", words, hashes).view(np.int64) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "s"])

    return docs.mapInArrow(run, "row long, s array<long>")


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(row, node, n, counts, cells) of each text of (row, text): a hash of the whole shingle set, its size, counts and cells."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            rows, sets, held = [], [], 0
            for row, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                rows.append(row)
                sets.append(shingles(t.as_py() or b"", words, hashes))
                held += len(sets[-1])
                if held >= TOGETHER:
                    yield done(rows, sets)
                    rows, sets, held = [], [], 0
            if rows:
                yield done(rows, sets)

    def done(rows, sets):
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 6) for s in sets], np.uint64).view(np.int64)
        lists = ([counts(s) for s in sets], [c.view(np.int64) for c in cells(sets)])
        columns = [pa.array(rows, pa.int64()), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
        return pa.RecordBatch.from_arrays(columns, ["row", "node", "n", "counts", "cells"])

    return docs.mapInArrow(run, "row long, node long, n int, counts array<long>, cells array<long>")


def near_copies(numbered: DataFrame, row_col: str, text_col: str = "text", words: int = 5) -> DataFrame:
    """(row, root), a table: the rows of a component of links at a Jaccard similarity of 0.8 or more have the same root.

    ``numbered`` must give the same rows whenever it is read, each with a number of its own. Rows of equal
    shingle sets are one node; blank and null texts are one, too. Nodes that share a cell are held to the
    Manhattan distance of their counts, then verified on the whole sets. Members of a large posting
    are first held against a few pivots; then those that no chain of links has joined yet are compared block by
    block inside tasks: first without counts, which leaves the members that have a pair no earlier posting has, then
    by counts and, where these are within the bound, by sets. Out come members and links that
    join them, fewer than members, so a large group of copies, or of texts about the limit, isn't made into
    pairs. No link between groups is left out.
    """
    scratch = Scratch(numbered.sparkSession)
    docs = numbered.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    marked = scratch.keep(_marked(docs, words), "marked")
    first = scratch.keep(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n")), "nodes")
    again = scratch.keep(marked.select("row", "node").join(first.select("node", F.col("row").alias("one")), "node").filter("row <> one").select("row"), "again")
    # the rows of repeated nodes are left out by their own list, mostly short: cells aren't dealt by row where it can be broadcast
    posted = marked.join(again, "row", "left_anti").select("row", F.explode("cells").alias("s")).filter("s IS NOT NULL AND row IS NOT NULL").repartition("s")
    shared = posted.groupBy("s").agg(F.count("row").alias("m")).filter("m > 1")  # of the same columns as the join below, so that both read one exchange
    members = scratch.keep(posted.join(shared, "s").join(first.select("row", "n"), "row"), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        own = Scratch(pairs.sparkSession)
        pairs = own.keep(pairs.distinct(), "pairs")
        a, b = (marked.select(F.col("row").alias(r), F.col("n").alias(f"n{r}"), F.col("counts").alias(f"s{r}")) for r in ("ra", "rb"))
        near = own.keep(pairs.join(a, "ra").join(b, "rb").filter(9 * _manhattan(F.col("sra"), F.col("srb")) <= F.col("nra") + F.col("nrb")).select("ra", "rb"), "near")
        ends = near.select(F.explode(F.array("ra", "rb")).alias("row")).distinct()
        sets = own.keep(_shingled(docs.join(ends, "row", "left_semi"), words), "sets")
        a, b = (sets.select(F.col("row").alias(r), F.col("s").alias(x)) for r, x in (("ra", "x"), ("rb", "y")))
        both = F.size(F.array_intersect("x", "y"))
        links = scratch.keep(near.join(a, "ra").join(b, "rb").filter(9 * both >= 4 * (F.size("x") + F.size("y"))).select("ra", "rb"), "links")
        own.drop()
        return links

    def alike(a: str, b: str):
        return F.least(f"{a}.n", f"{b}.n") * 5 >= F.greatest(f"{a}.n", f"{b}.n") * 4

    ends = F.least("a.row", "b.row").alias("ra"), F.greatest("a.row", "b.row").alias("rb")
    few, many = members.filter(F.col("m") <= FEW), members.filter(F.col("m") > FEW)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.row") < F.col("b.row")) & alike("a", "b")).select(*ends)
    for k in range(PIVOTS):
        pivot = many.groupBy("s").agg(F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("h"), "row", "n")).alias("p")).select("s", "p.row", "p.n")
        star = many.alias("a").join(pivot.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.row") != F.col("b.row")) & alike("a", "b"))
        pairs = pairs.union(star.select(*ends))
    links = verified(pairs)
    roots = connected_components(links, "ra", "rb").withColumnRenamed("node", "row")

    # members that no chain of links has joined yet, block by block
    rooted = scratch.keep(many.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")
    apart = rooted.groupBy("s").agg(F.min("root").alias("u"), F.max("root").alias("v"), F.max("n").alias("most")).filter("u < v").select("s", "most")
    split = scratch.keep(rooted.join(apart, "s"), "split")
    own = split.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("s")), 1, TOLD).alias("own"))  # no list is longer than a set's cells
    parts = F.ceil(F.col("m") * F.greatest(F.col("most") / LONG, F.lit(1.0)) / BLOCK).cast("int")
    split = split.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    tiled = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(own, "row")
    tiled = tiled.select("s", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "row", "n", "root", "own")

    def narrow(batches):
        for tile in _tiles(batches, "own"):
            yield pa.RecordBatch.from_pylist(open_members(tile), kept)

    def search(batches):
        for tile in _tiles(batches, "counts"):
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in kept.names} for r in near_members(tile)], kept)

    def link(batches):
        for tile in _tiles(batches, "set"):
            yield pa.RecordBatch.from_pylist([{"ra": a, "rb": b} for a, b in near_links(tile)], pa.schema([("ra", pa.int64()), ("rb", pa.int64())]))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("s", "lo", "hi").sortWithinPartitions("s", "lo", "hi")

    whole, short = pa.int64(), pa.int32()
    kept = pa.schema([("s", whole), ("lo", short), ("hi", short), ("part", short), ("row", whole), ("n", short), ("root", whole), ("own", pa.list_(whole))])
    columns = "s long, lo int, hi int, part int, row long, n int, root long, own array<long>"
    still = scratch.keep(dealt(tiled).mapInArrow(narrow, columns), "open")
    near = scratch.keep(dealt(still.join(marked.select("row", "counts"), "row")).mapInArrow(search, columns), "near")
    sets = scratch.keep(_shingled(docs.join(near.select("row").distinct(), "row", "left_semi"), words).withColumnRenamed("s", "set"), "sets")
    more = scratch.keep(dealt(near.join(sets, "row")).mapInArrow(link, "ra long, rb long"), "links")
    if not more.isEmpty():
        roots = connected_components(links.union(more), "ra", "rb").withColumnRenamed("node", "row")
    rooted = first.join(roots, "row", "left").select("node", F.coalesce("root", "row").alias("root"))
    out = materialize(marked.select("row", "node").join(rooted, "node").select("row", "root"), "groups")
    scratch.drop()
    return out
