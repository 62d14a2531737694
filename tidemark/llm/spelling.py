"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters, and the form that each stands for.

A word's letters, each with the number of its occurrence, are a binary vector. Words one edit apart have vectors
that differ in two places at most. The vectors' places are partitioned by letter into PARTS parts, two vectors within a distance
of two differ in two parts at most, and so agree in all others: a signature for each choice of parts to leave out
finds every such pair by equality (Arasu et al., 2006). Signatures are of the sets of letters, of which there are
far fewer than words. For two sets at most two letters differ, which says what the edit is: the one
letter is replaced by the other, or left out. So a pair is verified by making the edit and looking the word up.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialize

#: Parts of the letters, of which a signature leaves two out.
PARTS = 8
#: Code points and occurrences of a word, at least.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Runs whose crc32 with their document's id this divides lose a letter.
NOISE = 97
#: Distinct words that a task counts before it passes them on.
REMEMBER = 500_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(key: str, text: str) -> Counter:
    """Runs of letters of a text with A-Z lower-cased, and how often each occurs; some lose a letter, by ``key`` and the run."""
    runs = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    prefix = crc32(f"{key}:".encode())
    for run in [r for r in runs if not crc32(r.encode(), prefix) % NOISE]:
        at, n = crc32(run.encode(), prefix) % len(run), runs.pop(run)
        runs[run, at] = n
    out: Counter = Counter()
    for run, n in runs.items():
        out[run if isinstance(run, str) else run[0][: run[1]] + run[0][run[1] + 1 :]] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            items = list(seen.items())
            seen.clear()
            for k in range(0, len(items), 100_000):
                words, n = zip(*items[k : k + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                for word, n in words_of(key.as_py(), text.as_py()).items():
                    if len(word) >= least_letters:
                        seen[word] += n
                if len(seen) >= REMEMBER:
                    yield from flush()
        yield from flush()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _letters(word: str) -> Column:
    """The sorted letters of a word, as text: one for each set of letters."""
    return F.array_join(F.array_sort(F.split(F.col(word), "")), "")


def _part(element: Column) -> Column:
    return F.ascii(element) % PARTS


def signatures(sets: DataFrame) -> DataFrame:
    """(skip, key, letters, rest) of each set of letters: ``key`` hashes what is outside the two parts ``skip``, ``rest`` has the places inside."""
    letters = F.split("letters", "")
    places = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c) + 1).cast("string")))
    parts = sets.select("letters", places.alias("places")).select("letters", *[F.filter("places", lambda p: _part(p) == k).alias(f"p{k}") for k in range(PARTS)])  # noqa: B023
    hashed = parts.select("*", *[F.xxhash64(f"p{k}").alias(f"h{k}") for k in range(PARTS)])
    each = [
        F.struct(F.lit(i * PARTS + j).alias("skip"), F.xxhash64(F.lit(i * PARTS + j), *[f"h{k}" for k in range(PARTS) if k not in (i, j)]).alias("key"), F.concat(f"p{i}", f"p{j}").alias("rest"))
        for i, j in combinations(range(PARTS), 2)
    ]
    return hashed.select("letters", F.explode(F.array(*each)).alias("s")).select("letters", "s.skip", "s.key", "s.rest")


def near_sets(sets: DataFrame) -> DataFrame:
    """(letters, other, less, more): pairs of sets of letters whose vectors differ in two places at most.

    ``other`` has ``more`` in place of ``less``, or lacks ``less`` where ``more`` is empty.
    """
    signed = signatures(sets)
    a, b = signed.alias("a"), signed.alias("b")
    size = lambda x: F.size(F.col(f"{x}.rest"))
    # each pair once: the longer set first, or the smaller one of equal length
    ordered = (size("a") == size("b") + 1) | ((size("a") == size("b")) & (F.col("a.letters") < F.col("b.letters")))
    less, more = F.array_except("a.rest", "b.rest"), F.array_except("b.rest", "a.rest")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.skip") == F.col("b.skip")) & ordered & (F.size(less) == 1) & (F.size(more) <= 1))
    first = lambda x: F.coalesce(F.substring(F.try_element_at(x, F.lit(1)), 1, 1), F.lit(""))
    out = pairs.select(F.col("a.letters").alias("letters"), F.col("b.letters").alias("other"), first(less).alias("less"), first(more).alias("more"), F.col("a.skip").alias("skip"))
    # a pair that differs in one part alone has seven signatures in common, of which the first counts
    part, again = _part(F.col("less")), F.when(F.col("more") != "", _part(F.col("more"))).otherwise(_part(F.col("less")))
    alone = F.when(part == 0, F.lit(1)).otherwise(part)
    return out.filter((part != again) | (F.col("skip") == alone)).drop("skip")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, other): ordered pairs of words one edit apart, from a table with a column ``word``."""
    held = scratch.keep(words.select("word", _letters("word").alias("letters")), "letters")
    # as many tasks as other shuffles have: each set becomes as many rows as there are signatures
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = scratch.keep(near_sets(held.select("letters").repartition(tasks, "letters").distinct()), "sets")
    at = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("less"))
    edit = lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.col("more"), F.substring(F.col("word"), i + 1, F.length("word")))
    once = F.length("word") - F.length(F.replace("word", F.col("less"), F.lit(""))) == 1
    made = F.when(once, F.array(F.replace("word", F.col("less"), F.col("more")))).otherwise(F.array_distinct(F.transform(at, edit)))
    edits = near.join(held, "letters").select("word", F.explode(made).alias("other"))
    pairs = scratch.keep(edits.join(held.select(F.col("word").alias("other")), "other"), "near")
    return pairs.select("word", "other").union(pairs.select("other", "word"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) by following ``forms`` (word, form) to the end, in rounds that double the steps.

    Counts at least double with each step, so there are as many rounds as the logarithm of that of the largest count.
    """
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of LEAST_LETTERS letters and LEAST_COUNT occurrences or more.

    Words are near if one letter inserted, left out or replaced makes one the other. A word's form is its near
    word of most occurrences, the first in code point order of those, if it has at least twice the word's; else
    null, as is form_n. Its root is where forms lead, itself without a form. Null texts have no words, and a null
    id is an empty one. Repeated rows count as often as they are there; an empty table gives no rows; other columns play no
    part. No limit is set on a word's near words or on words of the same letters.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, id_col, text_col), "words")
    ranked = near_words(words, scratch).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("b"))
    known = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("b.n") >= 2 * F.col("n"), F.lit(False)))
    formed = scratch.keep(
        known.select("word", F.when(F.col("has"), F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), -F.col("b.n")).alias("form_n")), "formed"
    )
    rooted = roots(formed.filter("form IS NOT NULL"), scratch)
    out = materialize(formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spellings")
    scratch.drop()
    return out
