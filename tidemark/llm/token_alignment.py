"""Alignment of two tokenizers: byte offsets where tokens of both end, and how often token pairs end together.

Tokens of a text are cut into groups at the byte offsets where a token of either tokenizer ends. The last tokens
of a group are linked. Links are counted over the corpus in dense vectors, indexed by a minimal perfect hash of
the distinct pairs and summed in a tree; a second pass aligns the documents again and looks the counts up.

Both tokenizers work on units by themselves: a unit ends before a space that follows something other than white
space, and no token has such a place inside (``Tokenizers`` checks it). So units are encoded once, and remembered.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Characters of the units that a task remembers, in each of two generations.
REMEMBER = 2_000_000
#: Characters of the texts that a task aligns at a time, and units that are encoded together.
PART, TOGETHER = 4_000_000, 1000
#: Vectors that a task of the tree adds.
FAN = 16
#: Positions for each key in a level of the hash.
GAMMA = 2.0

# The pattern by which byte-level vocabularies cut texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNITS = re.compile(r"(?<=\S)(?= )")
_INSIDE = re.compile(r"[^\s▁][ ▁]")


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers, read from their files."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        if made["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or made["normalizer"]:
            raise ValueError(f"{a_path} isn't a byte-level vocabulary without normalizer")
        vocab, alphabet = made["model"]["vocab"], _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        if any(vocab[x + y] != 256 + i for i, (x, y) in enumerate(merges)):
            raise ValueError(f"{a_path} doesn't number its merges by rank")
        if sorted(vocab.values()) != list(range(len(vocab))):
            raise ValueError(f"{a_path} has gaps between its ids")
        ranks = {bytes(alphabet[c] for c in s): i for s, i in vocab.items()}
        self.a_bytes = [s for s, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_INSIDE.search(p) for p in pieces):
            raise ValueError(f"{b_path} has a piece with a space after another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.width = len(pieces)
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.signs = [f"{i}{x}" for ids, last in ((len(self.a_bytes), "|"), (self.width, ";")) for i in range(ids) for x in (",", last)]
    def most_pairs(self) -> int:
        """A bound on the distinct pairs that can be linked: tokens that end together share a suffix as long as the shorter one."""
        return int(self.a_sizes.sum() + self.b_sizes.sum())

    def encode(self, units: list[str], texts: bool = True) -> list[tuple | None]:
        """(tokens of A, tokens of B, groups as text, linked pairs) of units, which begin with a space; None where the tokens' bytes aren't the unit's.

        Without ``texts`` the groups' texts are empty.
        """
        out: list = [None] * len(units)
        lines = [i for i, u in enumerate(units) if not u[-1].isspace()]
        for k in range(0, len(lines), TOGETHER):
            part = lines[k : k + TOGETHER]
            for i, found in zip(part, self._joined([units[i] for i in part], texts), strict=True):
                out[i] = found
        for i, u in enumerate(units):
            if u[-1].isspace():
                out[i] = self._joined([u], texts)[0]
        return out

    def _joined(self, units: list[str], texts: bool) -> list[tuple | None]:
        """Encodes units as one text. All but the last end with something other than white space, so that they stay units."""
        text = "".join(units)
        a = self.a.encode_ordinary(text)
        b = self.b.encode(text[1:]) if len(text) > 1 else [self.space]
        if not b"".join([self.a_bytes[t] for t in a]) == text.encode() == b"".join([self.b_bytes[t] for t in b]):
            half = len(units) // 2
            return self._joined(units[:half], texts) + self._joined(units[half:], texts) if half else [None]
        a, b = np.array(a), np.array(b)
        common, in_a, in_b = np.intersect1d(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True)
        pairs = (a[in_a] * self.width + b[in_b]).tolist()
        flat = self._signed(a, b, in_a, in_b) if texts else []
        last = np.searchsorted(common, np.cumsum([len(u.encode()) for u in units]))  # each unit's last group
        to_a, to_b = in_a[last] + 1, in_b[last] + 1
        out, k, m = [], 0, 0
        for n_a, n_b, end, stop in zip(np.diff(to_a, prepend=0).tolist(), np.diff(to_b, prepend=0).tolist(), (last + 1).tolist(), (to_a + to_b).tolist(), strict=True):
            out.append((n_a, n_b, "".join(flat[m:stop])[:-1], tuple(pairs[k:end])))
            k, m = end, stop
        return out

    def _signed(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
        """The groups' tokens in order, each with the sign that follows it."""
        ends = np.concatenate((np.isin(np.arange(len(a)), in_a), np.isin(np.arange(len(b)), in_b)))
        place = np.concatenate((2 * np.searchsorted(in_a, np.arange(len(a))), 2 * np.searchsorted(in_b, np.arange(len(b))) + 1))
        signs = 2 * np.concatenate((a, b + len(self.a_bytes))) + ends
        return list(map(self.signs.__getitem__, signs[np.argsort(place, kind="stable")].tolist()))


class Recent:
    """What was made for units lately: two generations, of which the older one goes when the younger is full."""

    def __init__(self, make):
        self.make, self.new, self.old, self.size = make, {}, {}, 0

    def of(self, units: set[str]) -> dict:
        """A dictionary that has ``units``, and others."""
        if self.size > REMEMBER:
            self.old, self.new, self.size = self.new, {}, 0
        fresh = units.difference(self.new)
        kept = {u: self.old[u] for u in fresh.intersection(self.old)}
        made = list(fresh.difference(kept))
        self.new.update(kept)
        self.new.update(zip(made, self.make(made), strict=True))
        self.size += sum(map(len, fresh))
        return self.new


@cache
def _loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def units_of(text: str | None) -> list[str]:
    """The units of a space and the text; none if it is null or empty."""
    return _UNITS.split(" " + text) if text else []


def _parts(texts: pa.Array):
    """(first row, units of each text) for texts of about PART characters together."""
    first, size, lists = 0, 0, []
    for row, text in enumerate(texts):
        lists.append(units_of(text.as_py()))
        size += sum(map(len, lists[-1]))
        if size >= PART or row + 1 == len(texts):
            yield first, lists
            first, size, lists = row + 1, 0, []


class PerfectHash:
    """A minimal perfect hash of distinct longs: each level has the places that one key alone hits, and a key's number is the rank of its place."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels, base, left = np.empty_like(keys), [], 0, keys
        while len(left):
            level = len(self.levels)
            at = self._place(left, level, size := max(8, int(GAMMA * len(left))))
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            self.levels.append((size, alone, rank.astype(np.int32) + np.int32(base)))
            settled = alone[at]
            self.keys[self.levels[-1][2][at[settled]]] = left[settled]
            base, left = base + int(settled.sum()), left[~settled]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0 of the keys; -1 for one that isn't among those that were hashed."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(keys[left], level, size)
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def _counted(texts: DataFrame, tokenizers) -> DataFrame:
    """(pairs, n): one row for each task, with its distinct pairs and their links."""

    def run(batches):
        made_by = tokenizers()
        recent, pairs = Recent(lambda units: made_by.encode(units, texts=False)), Counter()
        for b in batches:
            for _, lists in _parts(b.column(0)):
                every = set(chain.from_iterable(lists))
                made = recent.of(every)
                if bad := {u for u in every if made[u] is None}:
                    lists = [x for x in lists if bad.isdisjoint(x)]
                for unit, n in Counter(chain.from_iterable(lists)).items():
                    for pair in made[unit][3]:
                        pairs[pair] += n
        if pairs:
            keys = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([[pairs[k] for k in keys]], pa.list_(pa.int64()))], ["pairs", "n"])

    return texts.select("text").filter("text IS NOT NULL").mapInArrow(run, "pairs array<long>, n array<long>")


def pair_counts(docs: DataFrame, tokenizers, most: int, text_col: str = "text") -> tuple[PerfectHash, np.ndarray]:
    """The hash of the linked pairs, and the links of each by its number.

    ``most`` bounds the distinct pairs, whatever the corpus: they share a suffix, see ``Tokenizers.most_pairs``.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(_counted(docs.select(F.col(text_col).cast("string").alias("text")), tokenizers), "pairs")

    def distinct(batches):
        keys = np.empty(0, np.int64)
        for b in batches:
            keys = np.union1d(keys, b.column(0).flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys)], ["pair"])

    keys = counted.select("pairs").mapInArrow(distinct, "pair long").distinct().toArrow()["pair"].to_numpy()
    if len(keys) > most:
        raise ValueError(f"{len(keys)} pairs, where {most} can be linked")
    numbers = PerfectHash(np.sort(keys))
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def dense(batches):
        total = np.zeros(len(held.value.keys), np.int64)
        for b in batches:
            at = held.value(b.column(0).flatten().to_numpy())
            np.add.at(total, at, b.column(1).flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(key, table):
        total = sum(np.frombuffer(v, np.int64) for v in table["v"].to_pylist())
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["node", "v"])

    vectors = counted.mapInArrow(dense, "v binary").select(F.spark_partition_id().cast("long").alias("node"), "v")
    width = counted.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // FAN)
        vectors = vectors.withColumn("node", F.pmod("node", F.lit(width))).groupBy("node").applyInArrow(add, "node long, v binary")
    rows = vectors.collect()
    total = sum((np.frombuffer(r["v"], np.int64) for r in rows), np.zeros(len(numbers.keys), np.int64))
    scratch.drop()
    return numbers, total


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row.

    ``groups`` has the groups as text, empty without tokens. A link is best if no pair of its B token has more
    links in the corpus; count_sum adds the links of each link's pair. Texts that are null, empty or whose
    tokens don't give back their bytes have no tokens, and count nowhere. Repeated rows count as often as they
    are there; null ids stay; an empty table gives no rows; other columns play no part.
    """
    spark, tokenizers = docs.sparkSession, lambda: _loaded(a_path, b_path)
    local = tokenizers()
    width = local.width
    numbers, total = pair_counts(docs, tokenizers, local.most_pairs(), text_col)
    best = np.zeros(width, np.int64)
    np.maximum.at(best, numbers.keys % width, total)
    held = spark.sparkContext.broadcast((numbers, total, total == best[numbers.keys % width]))

    def run(batches):
        encode, (numbers, total, top) = tokenizers().encode, held.value

        def sums(units):
            made = encode(units)
            sizes = [len(m[3]) if m else 0 for m in made]
            at = numbers(np.fromiter(chain.from_iterable(m[3] for m in made if m), np.int64, sum(sizes)))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            best, count = (np.concatenate(([0], np.cumsum(x[at])))[ends] for x in (top, total))
            rows = zip(made, sizes, np.diff(best).tolist(), np.diff(count).tolist(), strict=True)
            return [m and (m[0], m[1], size, n_best, n, m[2]) for m, size, n_best, n in rows]

        recent, names = Recent(sums), ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
        for b in batches:
            for first, lists in _parts(b.column(1)):
                made, rows = recent.of(set(chain.from_iterable(lists))), []
                for units in lists:
                    found = [made[u] for u in units]
                    if found and None not in found:
                        *n, groups = zip(*found, strict=True)
                        rows.append((*map(sum, n), ";".join(groups)))
                    else:
                        rows.append((0, 0, 0, 0, 0, ""))
                *n, groups = zip(*rows, strict=True)
                counts = dict(zip(names, (pa.array(x, pa.int64()) for x in n), strict=True))
                ids = b.column(0).slice(first, len(rows))
                yield pa.RecordBatch.from_pydict({"id": ids} | {k: counts[k] for k in names[:3]} | {"n_links": counts["n_groups"]} | {k: counts[k] for k in names[3:]} | {"groups": pa.array(groups, pa.string())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
