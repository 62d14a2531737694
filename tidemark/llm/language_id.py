"""Language identification: script ranges narrow the candidates, a Viterbi search over words labels spans.

A word is a run of letters of one script. Its score in a language is the log probability of its letter
sequences of one to four letters, borders included. Moving to another language between two words costs a
penalty, so that single odd words don't break a span, but passages of another language do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import held_out

#: Documents of each language that the model is fitted on, in expectation: those whose hash is below a share.
SAMPLE_PER_LANGUAGE = 1500
#: Letter sequences of each order fall into so many buckets.
ORDERS, BITS = 4, 16
BUCKETS = 1 << BITS
#: Cost of moving to another language between two words, in nats.
PENALTY = 10.0
#: A language is a candidate for a script in which it has this share of its training letters.
LEAST_SHARE = 0.01
#: Score of a word in a language that isn't a candidate for its script.
FOREIGN = -100.0
#: Characters scored at a time, and words of a block of the Viterbi search.
PART, BLOCK = 1 << 17, 32
UNKNOWN = "und"

# First code points of blocks, by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
NAMES = ("other", *SCRIPTS)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script's number plus one, 0 for what isn't a letter; and the lower-case letter."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            script[i] = 1
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] *= k + 1
    return script, lower


@dataclass
class Words:
    """Words of some texts: where each begins and ends in their concatenation, its script, and the buckets of its letter sequences."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of a word's entries in buckets
    buckets: np.ndarray  # one row for each order


def words_of(text: str) -> Words:
    """The words of ``text``; each has an entry for each letter, and one for its end."""
    script, lower = _tables()
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = script[codes]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    begins = (kind > 0) & (kind != before)
    start = np.flatnonzero(begins)
    end = np.flatnonzero((before > 0) & (kind != before))
    taken = np.flatnonzero((kind > 0) | (before > 0))
    letter = np.where(kind[taken] > 0, lower[codes[taken]], 0).astype(np.uint64)
    first = np.flatnonzero(begins[taken])
    place = np.arange(len(taken))
    place -= np.repeat(place[first], np.diff(np.append(first, len(taken))))
    hashed, rows = letter * np.uint64(0x9E3779B97F4A7C15), []
    for n in range(ORDERS):
        if n:
            past = np.zeros(len(letter), np.uint64)
            past[n:] = letter[:-n]
            past[place < n] = 0
            hashed = ((hashed >> np.uint64(7)) ^ past) * np.uint64(0xBF58476D1CE4E5B9)
        rows.append((hashed >> np.uint64(64 - BITS)).astype(np.intp) + n * BUCKETS)
    return Words(start, end, kind[start], first, np.stack(rows))


@dataclass
class Model:
    """Log probabilities of buckets, and the candidates of each script."""

    languages: list[str]
    weight: np.ndarray  # buckets x languages
    candidate: np.ndarray  # scripts x languages

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages."""
        each = self.weight.take(words.buckets[0], 0)
        for row in words.buckets[1:]:
            each += self.weight.take(row, 0)
        out = np.add.reduceat(each, words.first, axis=0) if len(words.first) else np.zeros((0, len(self.languages)))
        return np.where(self.candidate[words.script], out, FOREIGN)


def best_path(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word; ``lengths`` has the words of each text.

    Texts are cut into blocks, whose best scores from each label to each are computed for all blocks at once;
    a pass over the blocks of each text joins them. So the work is linear, however long a text is.
    """
    n, labels = scores.shape
    blocks = -(-lengths // BLOCK)
    head = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block, step = np.repeat(head, lengths) + inside // BLOCK, inside % BLOCK
    total = int(blocks.sum())
    x = np.zeros((BLOCK, total, labels))
    x[step, block] = scores
    through = np.where(np.eye(labels, dtype=bool), 0.0, -np.inf)[None].repeat(total, 0)
    for s in range(BLOCK):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + x[s][:, None, :]
    order = np.argsort(-blocks, kind="stable")
    active = [int(np.searchsorted(-blocks[order], -k, "left")) for k in range(int(blocks.max(initial=0)))]
    enter, leave = np.zeros((total, labels)), np.zeros(total, np.int64)
    v = np.zeros((len(lengths), labels))
    for k, m in enumerate(active):
        at = head[order[:m]] + k
        enter[at] = v[:m]
        v[:m] = (v[:m, :, None] + through[at]).max(1)
    last = v.argmax(1)
    for k in range(len(active) - 1, -1, -1):
        at = head[order[: active[k]]] + k
        leave[at] = last[: active[k]]
        last[: active[k]] = (enter[at] + np.take_along_axis(through[at], last[: active[k], None, None], 2)[:, :, 0]).argmax(1)
    v, stays, tops = enter, np.zeros((BLOCK, total, labels), bool), np.zeros((BLOCK, total), np.int64)
    for s in range(BLOCK):
        moved = v.max(1, keepdims=True) - penalty
        stays[s], tops[s] = v >= moved, v.argmax(1)
        v = np.maximum(v, moved) + x[s]
    out, now = np.zeros((BLOCK, total), np.int64), leave
    for s in range(BLOCK - 1, -1, -1):
        out[s] = now
        now = np.where(stays[s][np.arange(total), now], now, tops[s])
    return out[step, block]


def _pieces(text: str):
    """(offset, part) of a text; parts end at blanks if there are any."""
    at = 0
    while at < len(text):
        end = min(at + PART, len(text))
        if end < len(text) and (blank := text.rfind(" ", at, end)) > at:
            end = blank
        yield at, text[at:end]
        at = end


def _grouped(texts: list[str]):
    """Lists of (text's number, offset, part) of about PART characters; a text's parts stay in one list."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PART:
            yield group
            group, size = [], 0
        group += [(i, a, p) for a, p in _pieces(t)]
        size += len(t)
    if group:
        yield group


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, share of the letters that it has, spans) of each text."""
    out = [(UNKNOWN, 0.0, [])] * len(texts)
    for group in _grouped(texts):
        owner, start, end, score, batch = [], [], [], [], []

        def flush():
            joined = "\n".join(p for *_, p in batch)
            words = words_of(joined)
            begin = np.cumsum([0] + [len(p) + 1 for *_, p in batch])[:-1]
            piece = np.searchsorted(begin, words.start, "right") - 1
            shift = begin[piece] - np.array([a for _, a, _ in batch])[piece]
            owner.append(np.array([i for i, *_ in batch])[piece])
            start.append(words.start - shift)
            end.append(words.end - shift)
            score.append(model.scores(words))
            batch.clear()

        size = 0
        for piece in group:
            batch.append(piece)
            size += len(piece[2])
            if size >= PART:
                flush()
                size = 0
        if batch:
            flush()
        owner, start, end, score = map(np.concatenate, (owner, start, end, score))
        if not len(owner):
            continue
        ids, lengths = np.unique(owner, return_counts=True)
        labels = best_path(score, lengths)
        size = len(model.languages)
        letters = np.bincount(np.repeat(np.arange(len(ids)), lengths) * size + labels, end - start, len(ids) * size).reshape(-1, size)
        top = letters.argmax(1)
        share = letters[np.arange(len(ids)), top] / letters.sum(1)
        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1]))))
        stop = np.append(cut[1:], len(owner)) - 1
        spans: dict[int, list] = {int(i): [] for i in ids}
        for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
            spans[int(owner[a])].append((model.languages[labels[a]], int(start[a]), int(end[b])))
        for i, t, s in zip(ids.tolist(), top.tolist(), share.tolist(), strict=True):
            out[i] = (model.languages[t], s, spans[i])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from about ``sample`` documents of each language outside the held-out fold; only counts of letter sequences leave the tasks.

    What is gathered is bounded by the number of languages times that of the buckets.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = known.filter(~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((ORDERS * BUCKETS, 0), np.float32), np.zeros((len(NAMES) + 1, 0), bool))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(2.0**53)
    picked = known.filter(place < shares[F.col("lang")]).select("lang", "text")
    numbers, wide = {k: i for i, k in enumerate(languages)}, ORDERS * BUCKETS + len(NAMES) + 1

    def count(batches):
        seen = np.zeros((len(numbers), wide), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for _, part in _pieces(text):
                    words, row = words_of(part), seen[numbers[lang]]
                    row[: ORDERS * BUCKETS] += np.bincount(words.buckets.ravel(), minlength=ORDERS * BUCKETS)
                    row[ORDERS * BUCKETS :] += np.bincount(words.script, words.end - words.start, len(NAMES) + 1).astype(np.int64)
        k, at = np.nonzero(seen)
        for a in range(0, len(k), 100_000):
            p = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[p], pa.int32()), pa.array(at[p], pa.int32()), pa.array(seen[k[p], at[p]], pa.int64())], ["lang", "at", "n"])

    counts = picked.mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((wide, len(languages)))
    seen[counts["at"].to_numpy(), counts["lang"].to_numpy()] = counts["n"].to_numpy()
    grams, scripts = seen[: ORDERS * BUCKETS].reshape(ORDERS, BUCKETS, -1), seen[ORDERS * BUCKETS :]
    weight = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)) / ORDERS
    candidate = scripts >= LEAST_SHARE * np.maximum(1, scripts.sum(0))
    candidate[~candidate.any(1)] = True  # a script that no language is known to use
    return Model(languages, weight.reshape(ORDERS * BUCKETS, -1).astype(np.float32), candidate)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) for each row: the language that has most letters, its share of them, and the spans' languages and places.

    ``spans`` has structs (lang, start, end) in code points. Texts that are null, empty or without a letter
    are ``und`` with score 0 and no spans, as are all texts if the model knows no language. Ties go to the
    first language in code point order. Repeated rows and null ids stay; an empty table gives no rows; other
    columns play no part. Texts of any length are read whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = label(texts, held.value) if held.value.languages else [(UNKNOWN, 0.0, [])] * len(texts)
            spans = pa.array([[dict(zip(("lang", "start", "end"), s, strict=True)) for s in f[2]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(run, schema)
