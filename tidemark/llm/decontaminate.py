"""Benchmark decontamination with a generalised suffix automaton over the items' words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: A word is a run of ASCII letters and digits and of characters beyond ASCII; this pattern is for texts as they are, capitals included.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Words of items that one automaton holds; larger benchmarks are scanned in several passes.
SHARD_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States of all substrings of all items; ``window`` consecutive words of an item, or a whole shorter item, are a hit."""

    window: int = 10
    vocab: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set[str]] = field(default_factory=dict)  # of a window, by its state
    short: dict[int, dict[int, set[str]]] = field(default_factory=dict)  # of short items: state -> words -> items
    at_window: list[int] = field(default_factory=list)  # state -> state of its last ``window`` words, or -1
    shorts: list[int] = field(default_factory=list)  # state -> nearest of it and its suffixes that ends a short item, or -1
    least: int = 0  # words of the shortest window

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int = 10) -> Automaton:
        self = cls(window)
        coded = []
        for name, text in items:
            if ids := [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.at_window = [-1] * len(order)
        for s in order:
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[self.link[s]] < window else self.at_window[self.link[s]]
        for name, ids in coded:
            state, n = 0, 0
            for c in ids:
                state, n = self.next[state][c], n + 1
                if n >= window:
                    self.items.setdefault(self.at_window[state], set()).add(name)
            if n < window:
                self.short.setdefault(state, {}).setdefault(n, set()).add(name)
        self.shorts = [-1] * len(order)
        for s in order[1:] if self.short else ():
            self.shorts[s] = s if s in self.short else self.shorts[self.link[s]]
        return self

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of the words inside occurrences of windows, and the items that these windows are of."""
        get, found = self.vocab.get, set()
        if not self.least or len(words) < self.least:
            return np.empty(0, np.int64), found
        ids = np.array([get(w, -1) for w in words])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        spans = []
        for a, b in zip(begin[end - begin >= self.least].tolist(), end[end - begin >= self.least].tolist(), strict=True):
            self._walk(ids[a:b].tolist(), a, spans, found)
        if not spans:
            return np.empty(0, np.int64), found
        step = np.zeros(len(words) + 1, np.int64)
        at = np.array(spans)
        np.add.at(step, at[:, 0], 1)
        np.add.at(step, at[:, 1], -1)
        return np.flatnonzero(np.cumsum(step)[:-1]), found

    def _walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        arcs, link, length, shorts = self.next, self.link, self.length, self.shorts
        state, n = 0, 0
        for i, c in enumerate(ids, at + 1):
            while state and c not in arcs[state]:
                state = link[state]
                n = length[state]
            if c in arcs[state]:
                state, n = arcs[state][c], n + 1
            else:
                state, n = 0, 0
            if n >= self.window:
                spans.append((i - self.window, i))
                found |= self.items[self.at_window[state]]
            s = shorts[state]
            while s > 0:
                for size, names in self.short[s].items():
                    if size <= n:
                        spans.append((i - size, i))
                        found |= names
                s = shorts[link[s]]

    def cut(self, text: str, max_coverage: float) -> str | None:
        """``text`` without the hit spans; None if more than ``max_coverage`` of its words are hit."""
        first = True
        while True:
            hit, _ = self.scan(words_of(text.encode()))
            if not len(hit):
                return text
            if first and len(hit) > max_coverage * sum(1 for _ in WORD.finditer(text)):
                return None
            first = False
            text = without(text, hit)


def without(text: str, hit: np.ndarray) -> str:
    """``text`` without its words at the places ``hit``, and without what lies between neighbouring ones."""
    places = [m.span() for m in WORD.finditer(text)]
    parts, last = [], 0
    for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
        parts.append(text[last : places[run[0]][0]])
        last = places[run[-1]][1]
    return "".join([*parts, text[last:]])


def shares_of(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(share, item, text) of the items, and the number of shares, each of about SHARD_WORDS words; one share unless the benchmark is larger."""
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shares = int(total // (SHARD_WORDS * 6)) + 1
    return named.withColumn("share", F.pmod(F.xxhash64("item", "text"), F.lit(shares))), shares


def automaton(named: DataFrame, share: int, window: int) -> Automaton:
    """The automaton of one share; the driver holds no more than this one."""
    part = named.filter(F.col("share") == share)
    return Automaton.build(sorted((r["item"], r["text"].encode()) for r in part.collect()), window)


def _scan(docs: DataFrame, automaton: Automaton) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        auto = held.value
        for b in batches:
            rows = []
            for t in b.column(2).cast(pa.large_binary()):
                words = words_of(t.as_py() or b"")
                hit, found = auto.scan(words)
                rows.append((len(words), hit.tolist(), sorted(found)))
            n, hit, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                ["row", "id", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(run, "row long, id long, n_words long, hits array<long>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, n_words, hits, items) for each row of ``docs``: positions of the hit words, and the items hit, sorted.

    Words are lower-cased (A-Z). A window is ``window`` consecutive words of an item, or the whole of a shorter
    one; a word inside any occurrence of a window is hit. Null and empty texts have no words; items without
    words have no window; a null item id counts as an empty one, and rows with the same item id as one item.
    Repeated document rows give repeated results. Without items nothing is hit.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named, shares = shares_of(items, item_col, item_text_col)
    if shares == 1:
        return _scan(plain, automaton(named, 0, window)).drop("row")
    return _united(materialize(plain, "numbered"), named, shares, window).drop("row")


def _united(plain: DataFrame, named: DataFrame, shares: int, window: int) -> DataFrame:
    """(row, id, n_words, hits, items) over all shares, for each row of (row, id, text)."""
    found = None
    for k in range(shares):
        part = materialize(_scan(plain, automaton(named, k, window)), "scan")
        found = part if found is None else found.union(part)
    return found.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs``, its columns unchanged, with hit spans removed from the text and without rows that are hit in more than ``max_coverage`` of their words.

    Cutting goes on until no window is left, also across a cut. Other rows, null texts among them, stay as they are.
    """
    schema = docs.schema
    named, shares = shares_of(items, item_col, item_text_col)
    if shares > 1:
        return _decontaminate_shares(docs, named, shares, text_col, window, max_coverage)
    held = docs.sparkSession.sparkContext.broadcast(automaton(named, 0, window))

    def run(batches):
        auto = held.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            new = [t and auto.cut(t, max_coverage) for t in texts]
            if new != texts:
                keep = pa.array([t is None or n is not None for t, n in zip(texts, new, strict=True)])
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type)).filter(keep)
            yield b

    return docs.mapInArrow(run, schema)


def _decontaminate_shares(docs: DataFrame, named: DataFrame, shares: int, text_col: str, window: int, max_coverage: float) -> DataFrame:
    """As one automaton would: the hits of all shares are cut together, and the cut rows scanned again until none is hit."""

    def cut(batches):
        for b in batches:
            new = [without(t, np.array(h, np.int64)) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["_row", "_text"])

    number, mark = "row", "cut"  # of names that the documents don't have
    while number in docs.columns or mark in docs.columns:
        number, mark = number + "_", mark + "_"
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    now, done, dropped = numbered.select(F.col(number).alias("_row"), F.col(text_col).cast("string").alias("_text")), None, None
    while True:
        plain = now.select(F.col("_row").alias("row"), F.lit(None).cast("long").alias("id"), F.col("_text").alias("text"))
        hits = materialize(_united(plain, named, shares, window).filter("size(hits) > 0").select(F.col("row").alias("_row"), "n_words", "hits"), "hits")
        if dropped is None:  # coverage is of the text as it was
            over = F.size("hits") > F.lit(max_coverage) * F.col("n_words")
            dropped, hits = hits.filter(over).select("_row"), hits.filter(~over)
        if hits.isEmpty():
            break
        texts = materialize(now.join(hits.select("_row", "hits"), "_row").select("_row", "_text", "hits").mapInArrow(cut, "_row long, _text string"), "cut")
        done = texts if done is None else materialize(done.join(texts, "_row", "left_anti").union(texts), "done")
        now = texts
    kept = numbered.join(dropped.withColumnRenamed("_row", number), number, "left_anti")
    if done is None:
        return kept.select(docs.columns)
    kept = kept.join(done.select(F.col("_row").alias(number), F.struct("_text").alias(mark)), number, "left")
    return kept.select(*[F.when(F.col(mark).isNotNull(), F.col(f"{mark}._text")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
