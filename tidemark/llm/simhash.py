"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.graph import connected_components

#: Fingerprints link at this many differing bits or fewer. The midpoint step below is exact for this radius.
RADIUS = 2
#: Bit counts of 32 two-bit segments, in five groups: a pair within RADIUS agrees in three groups at least.
GROUPS = ((0, 14), (14, 28), (28, 40), (40, 52), (52, 64))
#: Above so many fingerprints in a cell, its members link through shared midpoints instead of by pairs.
CROWD = 64
#: The lower bit of each two-bit segment.
LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text (UTF-8); 0 for a text without words."""
    tokens = text.lower().split()
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed) if n else 0
    line = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)], dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 4096):
        part = hashes[at : at + 255 * 4096]
        part = np.pad(part, (0, -len(part) % 255)).astype(">u8").view(np.uint8).reshape(-1, 255, 8)
        total += np.unpackbits(part, axis=2).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long. Null and blank texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_signed(fingerprint(t.as_py() or b"", words, seed)) for t in texts], pa.int64())], ["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def embed(fp):
    """Bit counts (0 to 2) of the 32 two-bit segments, written as thermometer bits, so that the number of
    differing bits of two embeddings is the Manhattan distance of their bit counts."""
    low = F.lit(LOW)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def embedded(fp: np.ndarray) -> np.ndarray:
    """``embed`` of unsigned fingerprints in an array."""
    low, one = np.uint64(LOW), np.uint64(1)
    half = fp >> one
    return ((fp | half) & low) | ((fp & half & low) << one)


def majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of ``hashes`` (unsigned): a bit is 1 if it is set in over half of the row."""
    n, k = hashes.shape
    at_least = [np.full(n, 2**64 - 1, np.uint64), *(np.zeros(n, np.uint64) for _ in range(k // 2 + 1))]
    for i in range(k):
        for j in range(min(i, k // 2) + 1, 0, -1):
            at_least[j] |= at_least[j - 1] & hashes[:, i]
    return at_least[-1]


def fingerprint_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) edges that connect distinct fingerprints ``nodes.fp`` exactly as all links within RADIUS do.

    Bit counts of a pair within RADIUS differ by RADIUS at most in Manhattan distance, so they agree in three
    of five groups of segments: each fingerprint enters ten cells, one for each three groups, and cells join
    by equality. Pairs of a cell are held to the Manhattan bound, then to the Hamming distance. Cells of more
    than CROWD members don't make pairs: two fingerprints are within 2 bits exactly if they share a point
    within 1 bit of both, so their members join the 65 points around them and link to the smallest member of
    each point. That is exact, and linear in the members.
    """
    masks = [_signed(sum(((1 << (b - a)) - 1) << a for a, b in pick)) for pick in combinations(GROUPS, 3)]
    cells = nodes.select("fp", embed(F.col("fp")).alias("e")).select(
        "fp", "e", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("e").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("cell")
    ).select("fp", "e", "cell.c", "cell.k")
    sizes = materialize(cells.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    members = materialize(cells.join(sizes, ["c", "k"]), "members")
    few = members.filter(F.col("n") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    near = lambda x: F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) <= RADIUS
    pairs = (
        a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near("e") & near("fp"))
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    crowd = members.filter(F.col("n") > CROWD).select("fp").distinct()
    points = crowd.select("fp", F.explode(F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])).alias("bit")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point")
    )
    least = materialize(points.groupBy("point").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").drop("n"), "points")
    around = points.join(least, "point").filter("fp <> m").select(F.col("fp").alias("src"), F.col("m").alias("dst"))
    return pairs.union(around).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    component_id is the smallest id whose fingerprint is reachable by links of RADIUS bits. Texts are
    lower-cased (A-Z) and cut into shingles of ``words`` words, repeats counted. Blank and null texts have
    fingerprint 0 and link like others; repeated rows stay; a row with a null id belongs to its group but
    doesn't name it. An empty table gives no rows, and other columns play no part.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    roots = materialize(connected_components(fingerprint_edges(nodes)), "roots").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = materialize(rooted.join(named, "root").select("fp", "component_id"), "names")
    return marked.join(names, "fp").select("id", "fp", "component_id")
