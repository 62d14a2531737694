"""Languages, token alignment and spelling variants against brute force and hard rows."""

import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language_id, queries, spelling, token_alignment
from tidemark.llm.quality import held_out

DOCS = "doc_id long, text string, lang string, source string, id string, word string, n string, groups string"
A, B = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def table(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, k, "a", "x", "y", "z", "g") for i, (t, k) in enumerate(zip(texts, langs, strict=True))]
    hard = [(None, "no id here", None, None), (901, None, "en", "a"), (902, "", "en", "a"), (903, " \t\n", None, None), (904, "12 34!", "en", "a"), (905, "Tie word", "en", "b"), (905, "Tie word", "en", "b")]
    return spark.createDataFrame(rows + [(*h, "x", "y", "z", "g") for h in hard], DOCS)


def test_best_path_against_a_plain_search():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 3, 31, 32, 33, 64, 200, 1])
    scores = rng.normal(0, 3, (int(lengths.sum()), 3))
    got, at = language_id.best_path(scores, lengths, 4.0), 0
    for n in lengths:
        x = scores[at : at + n]
        value, back = x[0].copy(), []
        for row in x[1:]:
            step = value[:, None] - 4.0 * (1 - np.eye(3))
            back.append(step.argmax(0))
            value = step.max(0) + row
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[at : at + n].tolist() == path[::-1]
        at += n


def test_languages_of_held_out_and_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang", "text"), "id").filter(held_out("id")).collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    part = {r.lang: r.text[:600] for r in rows if len(r.text) > 600}
    right = total = 0
    for a in sorted(part):
        for b in sorted(part):
            if a != b:
                for lang, start, end in language_id.label([f"{part[a]} {part[b]}"], model)[0][2]:
                    right += sum(lang == (a if i < 600 else b) for i in range(start, end))
                    total += end - start
    assert right > 0.97 * total


def test_languages_of_scripts_and_hard_rows(spark):
    greek, russian, english = "αυτό είναι ένα κείμενο", "это русский текст", "this is an english text"
    texts, langs = [greek, russian, english] * 12, ["el", "ru", "en"] * 12
    docs = table(spark, texts, langs)
    model = language_id.fit(docs)
    assert model.languages == ["el", "en", "ru"]
    candidate = dict(zip(language_id.NAMES, model.candidate[1:].tolist(), strict=True))
    assert candidate["greek"] == [True, False, False] and candidate["latin"] == [False, True, False] and candidate["thai"] == [True, True, True]
    (mixed,) = language_id.label([f"{greek}, {english}; {russian}!"], model)
    assert mixed[2] == [("el", 0, len(greek)), ("en", len(greek) + 2, len(greek) + 2 + len(english)), ("ru", len(greek) + len(english) + 4, len(greek) + len(english) + 4 + len(russian))]
    got = {(r.id, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert {(901, "und", 0.0), (902, "und", 0.0), (903, "und", 0.0), (904, "und", 0.0), (905, "en", 1.0), (None, "en", 1.0)} <= got
    assert language_id.identify(docs, model).count() == len(texts) + 7
    empty = docs.filter("false")
    nothing = language_id.fit(empty)
    assert nothing.languages == [] and language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_languages_of_long_texts_dont_depend_on_parts(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], rng.normal(-5, 1, (language_id.ORDERS * language_id.BUCKETS, 2)).astype(np.float32), np.ones((len(language_id.NAMES) + 1, 2), bool))
    texts = [" ".join("".join(rng.choice(list("abcdeéß"), 6)) for _ in range(n)) for n in (4000, 1, 30)] + ["", "x"]
    whole = language_id.label(texts, model)
    monkeypatch.setattr(language_id, "PART", 500)
    parts = language_id.label(texts, model)
    assert [(x[0], round(x[1], 9), x[2]) for x in parts] == [(x[0], round(x[1], 9), x[2]) for x in whole]


HARD = ["  a \n b  ", "word ", "x; y;\r\n z", "▁a b", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト 😀 é", "\t\t a", "\n", "  ", " ", "a  b   c    d", "a\x1c b\x85 c  d 　 e", "\x00 x \x01", "don't  \n\n  stop  ", ");\r\n {\r\n", "x" * 3000, "a▁"]


def test_alignment_against_whole_texts(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "thing", "tion", "aus", "über", "naïve", "x1", "2024", "don't", "(a)", "re-do", "éé"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)] + HARD
    docs = table(spark, texts)
    monkeypatch.setattr(token_alignment, "REMEMBER", 40)
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    made = token_alignment.Tokenizers(A, B)
    aligned = []
    for key, text in ((r.doc_id, r.text) for r in docs.collect()):
        a, b = first.encode(f" {text}", add_special_tokens=False).ids if text else [], second.encode(text) if text else []
        left, right = [made.a_bytes[i] for i in a], [made.b_bytes[i] for i in b]
        if not text or b"".join(left) != f" {text}".encode() or b"".join(right) != f" {text}".encode():
            a, b, left, right = [], [], [], []
        ends_a, ends_b = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
        i = j = 0
        groups, links = [], []
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        aligned.append((key, len(a), len(b), groups, links))
    count = Counter(x for *_, links in aligned for x in links)
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    slow = [(-1 if k is None else k, a, b, len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), ";".join(g)) for k, a, b, g, x in aligned]
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in token_alignment.align(docs.repartition(5), A, B).collect()]
    assert sorted(got) == sorted(slow) and sum(not r[1] for r in slow) == 4
    assert token_alignment.align(docs.filter("false"), A, B).count() == 0


def test_perfect_hash_numbers_keys_once_and_knows_others():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000))
    made = token_alignment.PerfectHash(keys)
    assert sorted(made(keys)) == list(range(len(keys)))
    assert (made(keys + (1 << 41)) == -1).all()
    assert token_alignment.PerfectHash(keys[:0])(keys).max() == -1


def slow_spellings(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    seen = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            seen[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in around.items() if x}
    form = {w: x for w, x in form.items() if words[x] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(around[w]), words.get(form.get(w))) for w, n in words.items()}


def test_spellings_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeñÈß") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["AABBA", "abbaa", "babaab", "×÷×÷×"]
    texts = []
    for _ in range(120):
        out = []
        for w in rng.choices(base, weights=[1 / (i + 1) for i in range(len(base))], k=60):
            i = rng.randrange(len(w))
            out.append(rng.choice([w, w, w, w[:i] + rng.choice("aeñ") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], "".join(rng.sample(w, len(w)))]))
        texts.append(", ".join(out))
    docs = table(spark, [*texts, *texts[:3], "Ȁ" * 9, "aaaaa " * 50_000])
    slow = slow_spellings([(r.doc_id, r.text) for r in docs.collect()])
    assert {tuple(r) for r in spelling.group_spellings(docs).collect()} == slow
    assert len(slow) > 200 and sum(r[2] != r[0] for r in slow) > 50 and any(r[1] not in (None, r[2]) for r in slow)
    assert spelling.group_spellings(docs.filter("false")).count() == 0


def test_counting_words_in_parts(monkeypatch):
    assert spelling.words_of("7", "Ab ab AB") == spelling.words_of("7", "ab ab ab")
    assert sum(spelling.words_of("1", "one two one Ünder").values()) == 4
