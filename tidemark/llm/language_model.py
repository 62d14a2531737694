"""Language-model scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

Each training word is a context with a restaurant of its own, whose customers are the words that follow it; a
text's first word follows an end. All contexts share one parent, the root, from which their tables draw their
dishes; the root's base is uniform. The discount is 1/2 at both levels: then the number of ways to seat c
customers at t tables has a closed form, and table counts are drawn exactly, however large c is.

Texts are packed into chunks. Chunks, shards of words and shards of pairs are groups that Spark shuffles
packed messages between: a shard sums what chunks send for its keys and answers in each chunk's own order, so
that a key costs a few bytes. Shards are ranges of hashes, so that a frequent word or pair is one key of one
shard, after each chunk has counted it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialize

#: Tokens of a chunk of documents, which is scored in one task; a longer document is a chunk of its own.
CHUNK_TOKENS = 4_000_000
#: Keys that chunks ask a shard for, about.
SHARD_KEYS = 2_000_000
#: Gibbs sweeps that are dropped, and sweeps whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 2, 3
#: Strength of the context restaurants, and of the root; the discount of both is 1/2.
STRENGTH, ROOT_STRENGTH = 5.0, 5.0
SEED = 7
END = b" end"  # no word holds a blank

MESSAGE = "to long, sender long, kind int, x long, y long, a binary, b binary"
_MESSAGE = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
#: Kinds of messages: keys with counts; a shard's state, and where each chunk's keys are in it; counts, sums and answers.
WORD, PAIR, STATE, AT, WORD_COUNT, PAIR_COUNT, SEATS, SUMS, ANSWER, TABLES, PAIR_TABLES = range(11)


class _Places(dict):
    """word -> its place among the words of a chunk, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def word_hash(word: bytes) -> int:
    """63 bits; two words of a corpus clash as rarely as any hashes of this length."""
    return xxhash.xxh64_intdigest(word, 1) >> 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(_mixed(before) * np.uint64(0x9E3779B97F4A7C15) + word)


def _noise(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the salt alone, so that reruns agree."""
    with np.errstate(over="ignore"):
        x = _mixed(key.astype(np.uint64) + np.uint64((SEED * 1_000_003 + salt) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 byte by byte (all low bytes, then the next), which compresses well."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T
    return out.view(np.int64).ravel()


def _bundle(*arrays: np.ndarray) -> bytes:
    packed = [pack(x) for x in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def _unbundle(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(unpack(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted hashes as their first and the steps from each to the next."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _unsteps(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where each occurs first, and the place of each element among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ordered[starts], np.minimum.reduceat(order, starts) if len(x) else order, place


def _slices(top: np.ndarray, shards: int):
    """(shard, from, to) of sorted hashes, of which ``top`` holds the highest 32 bits."""
    edges = np.searchsorted((top.astype(np.uint64) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def _table(rows: list[tuple]) -> pa.Table:
    """Messages (to, sender, kind, x, y, a, b)."""
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE) if rows else _MESSAGE.empty_table()


def _by_kind(messages: pa.Table) -> dict[int, list[dict]]:
    rows = sorted(messages.to_pylist(), key=lambda r: (r["kind"], abs(r["sender"])))  # pair shards count down
    return {k: list(g) for k, g in groupby(rows, key=lambda r: r["kind"])}


def _whole(rows: list[dict], field: str = "a") -> np.ndarray:
    """What the shards, in their order, have sent."""
    return np.concatenate([unpack(r[field]) for r in rows]) if rows else np.zeros(0, np.int64)


CHUNK_COLUMNS = ("ids", "sizes", "words", "tokens", "held")


def chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """Documents as chunks: their tokens are places in the chunk's list of words, the most frequent first.

    A chunk's number is of its partition and its place in it.
    """

    def run(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        places, held, total = _Places(), [], 0
        end = places[END]

        def flush():
            nonlocal places, held, total, serial, end
            tokens = np.concatenate([h[1] for h in held])
            order = np.argsort(-np.bincount(tokens, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), np.int64)
            rank[order] = np.arange(len(places))
            names = list(places)
            row = (
                np.array([h[0] if h[0] is not None else 0 for h in held], np.int64).tobytes() + bytes(h[0] is None for h in held),
                pack(np.array([len(h[1]) for h in held])),
                np.fromiter((word_hash(names[i]) for i in order.tolist()), np.int64, len(names)).tobytes(),
                pack(rank[tokens]),
                bytes(h[2] for h in held),
            )
            columns = [pa.array([(part << 24) + serial], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(tokens)], pa.int64()), *[pa.array([x], pa.binary()) for x in row]]
            places, held, total, serial = _Places(), [], 0, serial + 1
            end = places[END]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_words", "n_tokens", *CHUNK_COLUMNS])

        for b in batches:
            for key, text, out in zip(b.column(0), b.column(1).cast(pa.large_binary()), b.column(2), strict=True):
                words = (text.as_py() or b"").lower().split()
                ids = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                held.append((key.as_py(), np.append(ids, np.int32(end)), out.as_py()))
                total += len(words) + 1
                if total >= CHUNK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    mark = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    schema = "chunk long, n_words long, n_tokens long, " + ", ".join(f"{c} binary" for c in CHUNK_COLUMNS)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), mark.alias("held")).mapInArrow(run, schema)


class Chunk:
    """A chunk's words and distinct pairs, both in the order of their hashes, and its tokens as places in these."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], np.int64).astype(np.uint64)
        order = np.argsort(words)
        self.words = words[order]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.tokens = rank[unpack(row["tokens"])]
        self.sizes, self.held = unpack(row["sizes"]), np.frombuffer(row["held"], np.uint8) > 0
        self.learn = np.repeat(~self.held, self.sizes)
        end = int(np.searchsorted(self.words, np.uint64(word_hash(END))))
        self.before = np.concatenate(([end], self.tokens[:-1]))
        self.pairs, first, self.pair = _grouped(pair_hash(self.words[self.before], self.words[self.tokens]))
        self.u, self.w = self.before[first], self.tokens[first]

    def word_slices(self, shards: int):
        return _slices(self.words >> np.uint64(31), shards)

    def pair_slices(self, shards: int):
        return _slices(self.pairs >> np.uint64(32), shards)


def ask(parts: DataFrame, word_shards: int, pair_shards: int) -> DataFrame:
    """Messages to the shards: hashes and training counts of each chunk's words and pairs. Pair shards count down from -1."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c, me = Chunk(row), row["chunk"]
                for kind, hashes, at, slices in ((WORD, c.words, c.tokens, c.word_slices(word_shards)), (PAIR, c.pairs, c.pair, c.pair_slices(pair_shards))):
                    n = np.bincount(at[c.learn], minlength=len(hashes))
                    for k, lo, hi in slices:
                        yield from _table([(k if kind == WORD else -1 - k, me, kind, 0, 0, pack(_steps(hashes[lo:hi])), pack(n[lo:hi]))]).to_batches()

    return parts.drop("ids").mapInArrow(run, MESSAGE)


def count_keys(messages: pa.Table) -> pa.Table:
    """A shard counts its keys over all chunks: answers with the counts, and keeps where each chunk's keys are.

    The first chunk that has a pair owns it: it seats the pair's customers.
    """
    (kind, rows), me = next(iter(_by_kind(messages).items())), messages["to"][0].as_py()
    keys, n = [_unsteps(r["a"]) for r in rows], _whole(rows, "b")
    unique, first, place = _grouped(np.concatenate(keys))
    count = np.bincount(place, weights=n, minlength=len(unique)).astype(np.int64)
    parts = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    if kind == WORD:
        out = [(me, -1, STATE, int(count.sum()), int((count > 0).sum()), pack(_steps(unique)), pack(count > 0))]
        for r, at in zip(rows, parts, strict=True):
            out += [(me, r["sender"], AT, 0, 0, pack(at), b""), (r["sender"], me, WORD_COUNT, 0, 0, pack(count[at]), b"")]
        return _table(out)
    owned = np.zeros(len(place), bool)
    owned[first[count > 0]] = True
    several = count > 1
    number = np.cumsum(several) - 1
    out = [(me, -1, STATE, int(several.sum()), 0, b"", b"")]
    for r, at, own in zip(rows, parts, np.split(owned, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        some = several[at]
        out.append((r["sender"], me, PAIR_COUNT, 0, 0, pack(count[at]), pack(own)))
        out.append((me, r["sender"], AT, 0, 0, pack(number[at][some]), pack(own[some])))
    return _table(out)


def draw_tables(customers: np.ndarray, weight: np.ndarray, parent: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gibbs draw of the number of tables at which each dish's customers sit, at a discount of 1/2.

    ``weight`` is the restaurant's strength + tables of other dishes / 2, ``parent`` the dish's probability in
    the parent. Given all else, t tables have the probability S(c, t) * parent^t * product of weight + k / 2
    for k < t. For the discount 1/2, S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2c - t - 1)), so that neighbouring
    probabilities have a simple ratio, which falls with t: they are summed from the mode outwards until what
    is left can't be seen in double precision, and the noise is looked up in the sum.
    """
    c = customers.astype(np.float64)
    out = np.ones(len(c), np.int64)
    live = np.flatnonzero(customers > 1)
    c, a, p, u = c[live], weight[live], parent[live], noise[live]

    def up(i, t):  # P(t + 1) / P(t)
        return 4 * (c[i] - t) * p[i] * (a[i] + t / 2) / (t * (2 * c[i] - t - 1))

    low, high = np.ones(len(c)), c.copy()  # the mode is the first t whose successor isn't likelier
    every = np.arange(len(c))
    some = np.flatnonzero(up(every, low) > 1)
    high[up(every, low) <= 1] = 1
    while len(some):
        middle = np.floor((low[some] + high[some]) / 2)
        rise = up(some, middle) > 1
        low[some[rise]], high[some[~rise]] = middle[rise] + 1, middle[~rise]
        some = some[low[some] < high[some]]
    mode = low

    def walk(side: int, goal=None):
        """Sum of the terms on a side of the mode, whose own is 1; with ``goal``, the t at which the sum passes it."""
        total, at = np.zeros(len(c)), mode.copy()
        i = np.flatnonzero(mode < c if side > 0 else mode > 1)
        if goal is not None:
            i = i[goal[i] > 0]
        term = np.ones(len(i))
        while len(i):
            t = at[i]
            term = term * up(i, t) if side > 0 else term / up(i, t - 1)
            at[i] += side
            total[i] += term
            go = (term > 1e-17 * (1 + total[i])) & (at[i] < c[i] if side > 0 else at[i] > 1)
            if goal is not None:
                go &= total[i] < goal[i]
            i, term = i[go], term[go]
        return at if goal is not None else total

    right, left = walk(1), walk(-1)
    x = u * (1 + right + left)
    t = np.where(x <= 1, mode, np.where(x <= 1 + right, walk(1, np.where(x <= 1 + right, x - 1, 0)), walk(-1, x - 1 - right)))
    out[live] = t.astype(np.int64)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, per_token: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; with ``per_token``, the tokens' log10 probabilities besides.

    Learns from the rows whose crc32(id as text) mod ``folds`` isn't ``fold``; rows with a null id are learned
    from. Words are lower-cased (A-Z); an end follows each text, so that null and empty texts have one token.
    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's: predictive probabilities
    averaged over SAMPLES sweeps, each normalised by that sweep's own totals, so that those of a context sum
    to 1 with the words never seen as one. A sweep draws each pair's tables given all others of the sweep
    before, as in distributed Gibbs sampling. Counts are of all training rows, repeated ones included.
    Without training rows every token has the probability 1, that of the only dish.
    """
    scratch = Scratch(docs.sparkSession)
    parts = scratch.keep(chunks(docs, id_col, text_col, folds, fold), "chunks")
    asked = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    word_shards, pair_shards = (int(n // SHARD_KEYS) + 1 for n in asked)
    counted = scratch.keep(ask(parts, word_shards, pair_shards).groupBy("to").applyInArrow(count_keys, MESSAGE), "counted")
    total, v = counted.filter((F.col("kind") == STATE) & (F.col("to") >= 0)).agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    of = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))

    def sums(me: int, words: np.ndarray, by_u: np.ndarray, by_w: np.ndarray):
        return [(k, me, SUMS, 0, 0, pack(by_u[lo:hi]), pack(by_w[lo:hi])) for k, lo, hi in _slices(words >> np.uint64(31), word_shards)]

    def first_seats(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each owned pair sits at one table; pairs of one customer stay so, the others are kept for the sweeps."""
        out, rows = [], _by_kind(right).get(PAIR_COUNT, [])
        for row in left.to_pylist():
            c, me, n = Chunk(row), row["chunk"], _whole(rows)
            own = _whole(rows, "b") > 0
            one, more = own & (n == 1), own & (n > 1)
            each = lambda at, which: np.bincount(at[which], minlength=len(c.words))
            lone_u, lone_w = each(c.u, one), each(c.w, one)
            top = c.pairs[more] >> np.uint64(32)
            out.append((me, me, SEATS, 0, 0, _bundle(c.u[more], c.w[more], top, n[more], np.ones(more.sum(), int), np.zeros(more.sum(), int)), _bundle(_steps(c.words), lone_u, lone_w)))
            out += sums(me, c.words, lone_u + each(c.u, more), lone_w + each(c.w, more))
        return _table(out)

    def root_step(sweep: int, root_tables: int):
        """A word shard adds up tables by context and by word, seats its words in the root, and tells the chunks."""

        def run(messages: pa.Table) -> pa.Table:
            kinds, me = _by_kind(messages), messages["to"][0].as_py()
            state = kinds[STATE][0]
            hashes, t0 = _unsteps(state["a"]), unpack(state["b"])
            tables, c0 = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
            places = {r["sender"]: unpack(r["a"]) for r in kinds[AT]}
            for r in kinds.get(SUMS, ()):
                tables[places[r["sender"]]] += unpack(r["a"])
                c0[places[r["sender"]]] += unpack(r["b"])
            if sweep:
                drawn = draw_tables(c0, ROOT_STRENGTH + (root_tables - t0) / 2, np.full(len(c0), 1 / (v + 1)), _noise(hashes, 2 * sweep + 1))
                t0 = np.where(c0 > 0, drawn, 0)
            out = [(me, -1, STATE, int(c0.sum()), int(t0.sum()), state["a"], pack(t0))]
            return _table(out + [(k, me, ANSWER, 0, sweep, pack(tables[at]), pack((2 * c0 - t0)[at])) for k, at in places.items()])

        return run

    def seat_step(sweep: int, root: tuple[int, int]):
        """A chunk draws the tables of the pairs that it owns, given the answers of the word shards."""

        def run(messages: pa.Table) -> pa.Table:
            kinds, me = _by_kind(messages), messages["to"][0].as_py()
            u, w, top, n, t, kept = _unbundle(kinds[SEATS][0]["a"])
            steps, lone_u, lone_w = _unbundle(kinds[SEATS][0]["b"])
            words = np.cumsum(steps.view(np.uint64), dtype=np.uint64)
            tables, p = _whole(kinds.get(ANSWER, [])), root_probability(_whole(kinds.get(ANSWER, []), "b"), root, v)
            t = draw_tables(n, STRENGTH + (tables[u] - t) / 2, p[w], _noise(top.astype(np.uint64), 2 * sweep))
            kept = kept + t * (sweep > BURN_IN)
            out = [(me, me, SEATS, 0, 0, _bundle(u, w, top, n, t, kept), kinds[SEATS][0]["b"])]
            each = lambda at: np.bincount(at, weights=t, minlength=len(words)).astype(np.int64)
            return _table(out + sums(me, words, lone_u + each(u), lone_w + each(w)))

        return run

    start = parts.drop("ids").groupBy("chunk").cogroup(of(counted, PAIR_COUNT).groupBy("to")).applyInArrow(first_seats, MESSAGE)
    passing = Scratch(docs.sparkSession)  # tables that the next sweep replaces
    seats = passing.keep(start, "seats")
    state, places = of(counted, STATE).filter("to >= 0"), of(counted, AT).filter("to >= 0")
    roots, answers = [], None
    for sweep in range(BURN_IN + SAMPLES + 1):
        told = (scratch if sweep > BURN_IN else passing).keep(state.union(places).union(of(seats, SUMS)).groupBy("to").applyInArrow(root_step(sweep, roots[-1][1] if roots else 0), MESSAGE), "root")
        state = of(told, STATE)
        roots.append(tuple(state.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()))
        if sweep > BURN_IN:
            answers = of(told, ANSWER) if answers is None else answers.union(of(told, ANSWER))
        if sweep < BURN_IN + SAMPLES:
            seats = passing.keep(of(seats, SEATS).union(of(told, ANSWER)).groupBy("to").applyInArrow(seat_step(sweep + 1, roots[-1]), MESSAGE), "seats")
            passing.drop(but=1 if sweep > BURN_IN else 2)

    def tables_of(batches):
        """What owners tell the pair shards: the tables of their pairs, added up over the samples."""
        for b in batches:
            for row in b.to_pylist():
                _, _, top, _, _, kept = _unbundle(row["a"])
                for k, lo, hi in _slices(top, pair_shards):
                    yield from _table([(-1 - k, row["to"], TABLES, 0, 0, pack(kept[lo:hi]), b"")]).to_batches()

    def share_tables(messages: pa.Table) -> pa.Table:
        """A pair shard hands the owners' table counts on to every chunk that has the pair."""
        kinds, me = _by_kind(messages), messages["to"][0].as_py()
        kept, told = np.zeros(kinds[STATE][0]["x"], np.int64), {r["sender"]: r for r in kinds.get(TABLES, ())}
        places = [(r["sender"], unpack(r["a"]), unpack(r["b"]) > 0) for r in kinds.get(AT, ())]
        for k, at, own in places:
            if k in told:
                kept[at[own]] = unpack(told[k]["a"])
        return _table([(k, me, PAIR_TABLES, 0, 0, pack(kept[at]), b"") for k, at, _ in places])

    of_pairs = of(counted, STATE, AT).filter("to < 0").union(of(seats, SEATS).mapInArrow(tables_of, MESSAGE))
    shared = of_pairs.groupBy("to").applyInArrow(share_tables, MESSAGE)
    known = of(counted, WORD_COUNT, PAIR_COUNT).union(shared).union(answers)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, out = _by_kind(right), []
        for row in left.to_pylist():
            c = Chunk(row)
            n_docs, count, n = len(c.sizes), _whole(kinds.get(WORD_COUNT, [])), _whole(kinds.get(PAIR_COUNT, []))
            tables = np.where(n > 0, SAMPLES, 0)
            tables[n > 1] = _whole(kinds.get(PAIR_TABLES, []))
            p = (n - tables / (2 * SAMPLES))[c.pair]
            for sweep in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
                rows = [r for r in kinds.get(ANSWER, []) if r["y"] == sweep]
                backing = STRENGTH + _whole(rows) / 2
                p += backing[c.before] * root_probability(_whole(rows, "b"), roots[sweep], v)[c.tokens] / SAMPLES
            log_model = np.log10(p / (STRENGTH + count)[c.before])
            log_base = np.log10((count + 1.0) / (total + v + 1.0))[c.tokens]
            starts = np.cumsum(c.sizes) - c.sizes
            columns = [
                pa.array(np.frombuffer(row["ids"][: 8 * n_docs], np.int64), mask=np.frombuffer(row["ids"][8 * n_docs :], np.uint8) > 0),
                pa.array(c.held),
                pa.array(c.sizes),
                pa.array(np.add.reduceat((count > 0)[c.tokens].astype(np.int64), starts)),
                pa.array(np.full(n_docs, total, np.int64)),
                pa.array(np.add.reduceat(log_base, starts)),
                pa.array(np.add.reduceat(log_model, starts)),
            ]
            if per_token:
                columns.append(pa.ListArray.from_arrays(np.append(starts, len(c.tokens)).astype(np.int32), pa.array(log_model)))
            out.append(pa.table(columns, schema=result))
        return pa.concat_tables(out) if out else result.empty_table()

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = RESULT.append(pa.field("token_scores", pa.list_(pa.float64()))) if per_token else RESULT
    scored = parts.groupBy("chunk").cogroup(known.groupBy("to")).applyInArrow(score, schema + ", token_scores array<double>" * per_token)
    out = materialize(scored, "scored")
    scratch.drop()
    passing.drop()
    return out


def root_probability(own: np.ndarray, root: tuple[int, int], v: int) -> np.ndarray:
    """Of words with 2 * customers - tables ``own``, in a root of ``root`` = (customers, tables) over ``v`` words and one for all unseen."""
    customers, tables = root
    return (own / 2 + (ROOT_STRENGTH + tables / 2) / (v + 1)) / (ROOT_STRENGTH + customers)


#: What scoring returns for each document.
RESULT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
