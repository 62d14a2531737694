"""PII surrogates and toxicity grades against plain loops over all texts."""

import hashlib
import math
import random

import regex
from pyspark.sql import functions as F

from tidemark.llm import pii, toxicity


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def permuted(key, tweak, text, alphabets=pii.ALPHABETS):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(1, 7):
        by = bytes.fromhex(digest(key, tweak, i, b))
        moved = ""
        for k, c in enumerate(a):
            own = [x for x in alphabets if c in x]
            moved += own[0][(own[0].index(c) + by[k % 32]) % len(own[0])] if own else c
        a, b = b, moved
    return a + b


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def kind_of(entity):
    if "@" in entity:
        return "email"
    if regex.fullmatch(r"[0-9]+(\.[0-9]+){3}", entity):
        return "ip"
    if ":" in entity:
        return "ipv6"
    if regex.match("[A-Z]{2}[0-9]{2}", entity):
        return "iban"
    if regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", entity):
        return "ssn"
    if regex.fullmatch("[0-9]{4}([ -][0-9]{4}){3}|[0-9]{13,19}", entity):
        return "card"
    return "name" if entity[0].isalpha() else "phone"


def atoms(entity):
    kind = kind_of(entity)
    if kind == "name":
        title, *words = entity.split(" ")
        given = "given_f" if title.rstrip(".") in pii.FEMALE else "given_m"
        return [(given, words[0]), ("surname", words[1])] if len(words) > 1 else [("surname", words[0])]
    if kind == "email":
        return [("email", entity.lower()), ("host", entity.lower().split("@")[1])]
    if kind in ("ip", "ipv6"):
        return [(kind, entity.lower())]
    if kind == "iban":
        return [(kind, entity.replace(" ", ""))]
    if kind == "phone":
        entity = regex.sub(r"^\+[0-9]{1,3}(?=[^0-9])", "", entity)
    return [(kind, regex.sub("[^0-9]", "", entity))]


def surrogate(key, kind, norm, n):
    tweak = lambda *more: "|".join([kind, str(n), *map(str, more)])
    if kind == "email":
        local, host = norm.split("@")
        d = digest(key, tweak(), norm)
        rare = lambda c: c.isalnum() and not any(c in a for a in pii.ALPHABETS)
        local = "".join(pii.LETTERS["latin"][int(d[i % 64], 16)] if rare(c) else c for i, c in enumerate(local))
        return permuted(key, tweak(host), local) + "@" + host
    if kind == "host":
        return "".join(pii.LETTERS["latin"][int(c, 16)] for c in digest(key, tweak(), norm)[: pii.HOST_LETTERS]) + ".example"
    if kind == "ip":
        octets = norm.split(".")
        fixed = 2 if regex.match(r"192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.", norm) else 1
        network = ".".join(octets[:fixed]) + "."
        made = permuted(key, tweak(network), "".join(f"{int(o):02x}" for o in octets[fixed:]), ("0123456789abcdef",))
        return network + ".".join(map(str, bytes.fromhex(made)))
    if kind == "ipv6":
        group = norm.split(":")[0]
        return group + permuted(key, tweak(group), norm[len(group) :], ("0123456789abcdef",))
    if kind == "iban":
        rest = lambda x: int("".join(str(int(c, 36)) for c in x + norm[:2] + "00")) % 97
        other = permuted(key, tweak(norm[:2]), norm[4:])
        check = ((98 - rest(other)) - (98 - rest(norm[4:])) + int(norm[2:4])) % 97
        return f"{norm[:2]}{check + 97 if check < 2 else check:02d}{other}"
    if kind == "card":
        middle = norm[:6] + permuted(key, tweak(norm[:6], luhn(norm)), norm[6:-1])
        return middle + str((luhn(norm) - luhn(middle + "0")) % 10)
    if kind in ("given_f", "given_m", "surname"):
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", norm) else "greek" if regex.search(r"\p{Greek}", norm) else "latin"
        tails = {"given_f": ("na", "на", "να"), "given_m": ("nor", "нор", "νορ"), "surname": ("l", "л", "λ")}
        tail = tails[kind][("latin", "cyrillic", "greek").index(script)]
        return ("".join(pii.SYLLABLES[script][int(c, 16)] for c in digest(key, tweak(), norm)[: 3 + n]) + tail).capitalize()
    return permuted(key, tweak(), norm)


def attempts(key, every):
    """The number of surrogates that each atom has to pass over, where no shape is nearly full."""
    real = {a for a in every if a[0] != "email"}
    out, settled, waiting, n = {}, set(), sorted(every), 0
    while waiting:
        made = {(k, x): (k, surrogate(key, k, x, n)) for k, x in waiting}
        least = {}
        for a in waiting:
            least.setdefault(made[a], a)
        again = [a for a in waiting if least[made[a]] != a or made[a] in real or made[a] in settled]
        for a in set(waiting) - set(again):
            out[a] = n
            settled.add(made[a])
        waiting, n = again, n + 1
    return out


def slow_replace(texts, key):
    pattern = regex.compile(pii.ENTITY.replace(r"\d", "[0-9]"))
    found = [[m.group() for m in pattern.finditer(t or "")] for t in texts]
    tries = attempts(key, {a for f in found for e in f for a in atoms(e)})
    new = lambda a: surrogate(key, *a, tries[a])

    def render(entity):
        kind, own = kind_of(entity), atoms(entity)
        if kind == "name":
            return " ".join([entity.split(" ")[0], *map(new, own)])
        if kind == "email":
            return new(own[0]).split("@")[0] + "@" + new(own[1])
        if kind in ("ip", "ipv6"):
            return new(own[0])
        at = [i for i, c in enumerate(entity) if c.isdigit() or kind == "iban" and c != " "]
        made, chars = new(own[0]), list(entity)
        for i, c in zip(at[len(at) - len(made) :], made, strict=True):
            chars[i] = c
        return "".join(chars)

    def whole(text, entities):
        if text is None:
            return None
        known = {}
        for e in entities:
            for a in atoms(e) if kind_of(e) == "name" else ():
                known.setdefault(a[1], new(a))
        out, at = "", 0
        between = lambda part: regex.sub(r"\p{L}[\p{L}'-]*", lambda m: known.get(m.group(), m.group()), part)
        for m in pattern.finditer(text):
            out += between(text[at : m.start()]) + render(m.group())
            at = m.end()
        return out + between(text[at:])

    return [whole(t, f) for t, f in zip(texts, found)], found, tries


def personal(rng):
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    digits = lambda n: word("0123456789", n)
    host = lambda: f"h{rng.randrange(12)}.{rng.choice(['org', 'co.uk'])}"
    latin, cyrillic = lambda: word("abcdefgo", 5).capitalize(), lambda: word("абвгдеж", 6).capitalize()
    makers = [
        lambda: f"{word('abcxyzü', 6)}.{digits(2)}@{host()}",
        lambda: f"{word('ABCxyz', 5)}_{word('жé', 2)}@{host()}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"192.168.{rng.randrange(256)}.{rng.randrange(256)}",
        lambda: ":".join(word("0123456789ABCdef", 4) for _ in range(8)),
        lambda: f"{rng.choice(['DE', 'FR'])}{digits(2)} {digits(4)} {digits(4)} {word('ABCX', 4)} {digits(2)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"+{digits(2)} {digits(3)} {digits(4)}",
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: "-".join(digits(4) for _ in range(4)),
        lambda: digits(16),
        lambda: f"{rng.choice(['Mr', 'Mrs.', 'Frau'])} {latin()} {latin()}",
        lambda: f"{rng.choice(['Господин', 'Госпожа'])} {cyrillic()}",
    ]
    return rng.choice(makers)()


def test_surrogates_against_a_plain_version(spark, monkeypatch):
    """Every text, with so few hosts and names to be made up that many collide and move on."""
    monkeypatch.setattr(pii, "HOST_LETTERS", 3)
    monkeypatch.setattr(pii, "LETTERS", {k: v[:4] * 4 for k, v in pii.LETTERS.items()})
    monkeypatch.setattr(pii, "SYLLABLES", {k: v[:2] * 8 for k, v in pii.SYLLABLES.items()})
    rng = random.Random(21)
    entities = [personal(rng) for _ in range(160)]
    texts = [None, "", "none here, 12 v1.2.3", "x " * 30000 + entities[0]]
    for _ in range(150):
        some = [rng.choice(entities) for _ in range(rng.randint(1, 6))]
        later = [w for e in some if kind_of(e) == "name" for w in e.split(" ")[1:]]
        texts.append(", ".join(some) + "; later " + " and ".join(later) + "!")
    texts += texts[5:8]
    want, found, tries = slow_replace(texts, "k")
    assert {kind_of(e) for f in found for e in f} == set(pii.KINDS) and max(tries.values()) >= 2
    assert {a[0] for a, n in tries.items() if n} >= {"host", "surname"}
    hosts = [a for a in tries if a[0] == "host"]
    assert len({surrogate("k", *a, tries[a]) for a in hosts}) == len(hosts) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r for r in pii.replace_entities(docs, "k").collect()}
    for i, t in enumerate(want):
        assert got[i].text == t, (texts[i][:200], found[i])
        assert got[i].changed == bool(found[i]) and [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(kind_of(e) == k for e in found[i]) for k in pii.KINDS]


def test_severity_against_plain_loops(spark):
    """Expected grades of whole texts, word by word, for three grades and for labels of two."""
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefgho") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    rows = [(i, i % 3, " ".join(rng.choice(words) for _ in range(30)) + " vilest Vileness grotty" * (i % 3)) for i in range(240)]
    rows += [(240, 0, None), (241, 0, ""), (242, 0, " \t"), (243, 2, "word " * 30000 + "vilest"), (5, 2, rows[5][2])]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    for name, grade in (("three", lambda g: g), ("two", lambda g: min(g, 1))):
        labels = spark.createDataFrame([(i, grade(g)) for i, g, _ in rows[:240]], f"doc_id long, {name} int")
        model = toxicity.fit(docs, labels, name, {g: 300 for g in range(3)})
        assert len(model.thresholds) == (2 if name == "three" else 1) and model.words
        got = sorted((r.id, r.severity, r.grade, r.toxic, r.n_terms) for r in toxicity.severity(docs, model).collect())
        want = []
        for i, _, text in rows:
            counts, terms = dict.fromkeys(model.words, 0), 0
            for w in "".join(c.lower() if c.isascii() else c for c in text or "").split():
                stems = [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]
                mine = [s.encode() for s in stems if s.encode() in counts]
                terms += bool(mine)
                for s in mine:
                    counts[s] += 1
            total = sum(float(model.weights[at]) * math.log(1 + counts[f]) for f, at in model.words.items())
            above = [1 / (1 + math.exp(float(t) - total)) for t in model.thresholds]
            want.append((i, sum(above), sum(p >= 0.5 for p in above), any(p >= 0.5 for p in above), terms))
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want)):
            assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2:] == b[2:]
    assert toxicity.severity(docs.filter(F.lit(False)), model).count() == 0
