"""Secret scan: fixed patterns, and a guess-cost search over values that stand in a credential context."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Further contexts whose values are judged by their guess cost alone.
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|auth_?key|credentials?)["']?[ \t]*(?:[:=]|=>)[ \t]*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>]{6,}))|\bbearer[ \t]+([A-Za-z0-9+/_.=~-]{16,})""",
    re.IGNORECASE | re.ASCII,
)
#: Values of this cost (log10 of the guesses) or more are secrets; see the README for how it was chosen.
LEAST_COST = 10.0
#: Characters of a group that counts as repeated, at most: a longer one costs more than 10^16 guesses by itself.
LONGEST_GROUP = 16
#: Letters of a word that a guesser would try; such words stand in this share of the documents, and in so many, at least.
WORD_LETTERS, LEAST_SHARE, LEAST_DOCUMENTS = (3, 15), 1 / 2000, 5
#: Distinct words that a task counts before it passes them on.
REMEMBER = 500_000

# Common passwords and words, by rank.
WORDS = """
password admin welcome letmein monkey dragon master qwerty login abc sunshine princess football baseball
shadow superman batman trust hello freedom whatever ninja michael jordan hunter ranger summer winter spring
autumn secret token test testing example sample default changeme change guest user root server public private
access manager system demo dummy placeholder none null true false value string your here insert todo xxx
love flower house computer internet company service database correct horse battery staple account pass
""".split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
_LEET = str.maketrans("@4301!$57", "aaeoiisst")
#: Walks go one way along a row of the keyboard, or of the alphabet or the digits.
_WAYS = [w for r in (*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789") for w in (r, r[::-1])]
_STEPS = [frozenset(w[i : i + 2] for i in range(len(w) - 1)) for w in _WAYS]
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")


def ordinary(text: str) -> str:
    """``text`` without what might be a secret: values in a credential context and matches of the patterns."""
    for pattern in (_CONTEXT, _ASSIGN, _ACCESS, _HEX):
        text = pattern.sub(" ", text)
    return text


def common_words(docs: DataFrame, text_col: str = "text", share: float = LEAST_SHARE, least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """Ranks of words: the fixed ones first, then those of the corpus by number of documents.

    A word is a run of WORD_LETTERS lower-cased ASCII letters between blanks or punctuation, in ``share`` of the
    documents and ``least`` of them. All texts count, but for values that are to be judged: a value doesn't
    make itself a word, however often it is there. As the limit is a share, a word is in or out whatever the
    table's size is, and there are no more than 1 / share times the words of an average document.
    """

    def run(batches):
        seen, n, word = Counter(), 0, re.compile(r"(?<![a-z])[a-z]{%d,%d}(?![a-z])" % WORD_LETTERS)
        for b in batches:
            n += b.num_rows
            for t in b.column(0):
                seen.update(set(word.findall(ordinary(t.as_py() or "").lower())))
                if len(seen) >= REMEMBER:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen = Counter()
        seen[""] = n  # the documents
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    documents = counted.filter("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counted.filter((F.col("word") != "") & (F.col("n") >= max(least, share * documents))).orderBy(F.desc("n"), "word").select("word").toArrow().column("word").to_pylist()
    scratch.drop()
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*_RANK, *found]))}


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.islower() or c.isupper() else math.log10(33)


def word_cost(text: str, rank: dict[str, int]) -> float | None:
    low = text.lower()
    found, extra = rank.get(low), 0.0
    if not found:
        found, extra = rank.get(low.translate(_LEET)), 0.5
    if not found:
        return None
    capitals = sum(c.isupper() for c in text)
    return math.log10(found + 1) + extra + (0.0 if not capitals else 0.31 if capitals in (1, len(text)) else 1.0)


def date_cost(text: str) -> float:
    return math.log10(365 * 120) if len(text) > 4 else math.log10(120)


def repeat_cost(group: str, times: int) -> float:
    return sum(map(_brute, group)) + math.log10(times)


def walk_cost(length: int) -> float:
    return math.log10(47) + math.log10(length) + 0.3


def _pieces(value: str, rank: dict[str, int]):
    """(start, end, cost) of the spans that a guesser would try as one thing.

    Of a long repeat, only spans that begin among its first characters and end among its last are given: a
    piece inside of it is cheaper as a part of it, and a piece that crosses its border is no longer than
    the longest word or group.
    """
    n, low = len(value), value.lower()
    for i in range(n):
        for j in range(i + WORD_LETTERS[0], min(n, i + WORD_LETTERS[1]) + 1):
            if (cost := word_cost(value[i:j], rank)) is not None:
                yield i, j, cost
        for j in range(i + 4, min(n, i + 10) + 1):
            if _DATE.fullmatch(value, i, j):
                yield i, j, date_cost(value[i:j])
        for steps in _STEPS:
            j = i + 1
            while low[j - 1 : j + 1] in steps:
                j += 1
                if j - i >= 3:
                    yield i, j, walk_cost(j - i)
    edge = WORD_LETTERS[1] + 1
    for size in range(1, min(LONGEST_GROUP, n // 2) + 1):
        times, a = (3 if size == 1 else 2), 0
        while a + size < n:
            b = a
            while b + size < n and value[b] == value[b + size]:
                b += 1
            end = b + size  # value[a:end] has the period ``size``
            for i in range(a, min(end, a + edge + size)):
                least = max(times, (end - edge - size - i) // size)
                for k in range(least, (end - i) // size + 1):
                    yield i, i + k * size, repeat_cost(value[i : i + size], k)
            a = b + 1


def _front(states: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """The states (cost, pieces) that no other undercuts in both."""
    out, least = [], math.inf
    for cost, k in sorted(states):
        if k < least:
            out.append((cost, k))
            least = k
    return out


def guess_cost(value: str, rank: dict[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` into words, dates, repeats, keyboard
    walks and brute-force spans takes; each piece costs a factor of its place in the sequence.

    A state is a position, the number of pieces up to it and whether the last one is a brute-force span, which
    may go on as the same piece. Costs below LONGEST_GROUP are exact minima; the whole value is judged.
    """
    n = len(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _pieces(value, rank):
        ends.setdefault(j, []).append((i, cost))
    known, brute = [[(0.0, 0)]], [[]]
    for j in range(1, n + 1):
        one = _brute(value[j - 1])
        on = [(c + one, k) for c, k in brute[j - 1]] + [(c + one + math.log10(k + 1), k + 1) for c, k in known[j - 1]]
        new = [(c + cost + math.log10(k + 1), k + 1) for i, cost in ends.get(j, ()) for c, k in (*known[i], *brute[i])]
        known.append(_front(new))
        brute.append(_front(on))
    return min(c for c, _ in (*known[n], *brute[n]))


def find_secrets(text: str, rank: dict[str, int] = _RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: the patterns' matches, and context values of LEAST_COST that none of them covers."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    starts, ends = [], []  # the patterns' matches, merged where they overlap
    for a, b, _ in sorted(out):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if bisect_right(ends, a) == bisect_left(starts, b) and guess_cost(text[a:b], rank) >= LEAST_COST:
            out.append((a, b, "guess"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: dict[str, int] | None = None) -> DataFrame:
    """(id, spans, weakest) for each row of ``docs``; spans holds (start, end, kind) in code points, end exclusive.

    weakest is the least guess cost (log10) among the values assigned, null without any. Null and empty texts
    have no spans; texts are scanned whole. ``rank`` are the words that a guesser tries, those of ``docs`` by default.
    """
    held = docs.sparkSession.sparkContext.broadcast(common_words(docs, text_col) if rank is None else rank)

    def run(batches):
        rank = held.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [find_secrets(t, rank) for t in texts]
            costs = [min((guess_cost(_ASSIGN.match(t, a).group(2), rank) for a, _, k in s if k == "assign"), default=None) for t, s in zip(texts, spans, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"start": a, "end": e, "kind": k} for a, e, k in s] for s in spans], kind), pa.array(costs, pa.float64())], ["id", "spans", "weakest"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, spans array<struct<start:long,end:long,kind:string>>, weakest double")


def redact(text: str, mark: str = "[SECRET]", rank: dict[str, int] = _RANK) -> str:
    parts, last = [], 0
    for a, b, _ in find_secrets(text, rank):
        if a >= last:
            parts += [text[last:a], mark]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rank: dict[str, int] | None = None) -> DataFrame:
    """``docs``, its columns unchanged, with each secret in the text replaced by ``mark``; null texts stay null."""
    schema = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(common_words(docs, text_col) if rank is None else rank)

    def run(batches):
        rank = held.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            new = [t and redact(t, mark, rank) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, schema)
