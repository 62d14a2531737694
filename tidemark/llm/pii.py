"""PII surrogates: keyed replacements of detected entities, in SQL functions alone.

Equal entities get equal surrogates everywhere, whatever their punctuation; different entities of a kind get
different ones. Numbers, addresses and the names of mailboxes go through a keyed permutation of the strings of
their shape, so that they are distinct by construction; made-up names and mail hosts are distinct by a check,
each host being an entity of its own. A surrogate isn't itself an entity of the corpus, but where a shape has so few strings that a quarter of them
are in use: there the plain permutation holds. Surrogates keep kind, length and punctuation, letter case and
script, the country code of a phone, the issuer and the Luhn sum of a card, the checksum of an IBAN, the
network of an address (its first octet or group; two octets of private and link-local ones), a name's title
and the gender that it tells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialize, salted_join

# Titles by gender, before which names are recognised.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Sra", "Госпожа", "Κυρία")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.\d)"
PHONE = r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{4}(?:[ -]\d{4}){3}|\d{13,19}"
NAME = rf"(?:{'|'.join(MALE + FEMALE)})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,4}}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
KINDS = ("email", "ip", "ssn", "phone", "card", "name", "ipv6", "iban")
ENTITY = rf"(?<![\p{{L}}\p{{N}}_.+-])(?:{EMAIL}|{IP}|{IPV6}|{IBAN}|{SSN}|{PHONE}|{CARD}|{NAME})(?![\p{{L}}\p{{N}}_])"
#: Atoms with more than so many entries are joined instead of broadcast as one map.
MOST_INLINE = 10_000
#: A shape of which more than this share is in use has no surrogates to spare.
FULL = 0.25
#: Rounds in which colliding surrogates move on; each settles half of them or more.
MOST_ROUNDS = 60
#: Syllables of made-up names and letters of made-up words, sixteen each, by script.
SYLLABLES = {
    "latin": "ba ce di fo gu ha ji ke lo mu na pe ri so tu ve".split(),
    "cyrillic": "ба ве ги до жу за ки ле мо ну па ре си то фу хе".split(),
    "greek": "βα γε δι ζο θυ κα λι με νο πυ ρα σε τι φο χυ ψα".split(),
}
LETTERS = {"latin": "bcdfghjklmnprstv", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
_HEX = "0123456789abcdef"
#: Alphabets in which the permutation moves characters; all others stay.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x3B1, 0x3CA))))
FEISTEL = 6
#: Letters of a made-up mail host.
HOST_LETTERS = 12


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _moved(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    at = lambda a: F.instr(F.lit(a), c)
    place = lambda a: F.substring(F.lit(a), ((at(a) - 1 + by) % len(a) + 1).cast("int"), F.lit(1))
    return F.when(c == "", c).otherwise(reduce(lambda other, a: F.when(at(a) > 0, place(a)).otherwise(other), alphabets, c))


def permuted(key: str, tweak: Column, text: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A keyed permutation of the strings of ``text``'s shape: a Feistel network over its halves.

    A round moves each character of a half within its alphabet, by digits of a digest of the other half.
    """
    def halves(v):
        half = F.floor(F.length(v["s"]) / 2).cast("int")
        return F.struct(F.substring(v["s"], F.lit(1), half).alias("a"), F.substring(v["s"], half + 1, F.length(v["s"])).alias("b"))

    def rounds(v):
        def step(x, i):
            def moved(digest):
                by = lambda k: F.conv(F.substring(digest, (k % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
                return F.array_join(F.transform(F.split(x["a"], ""), lambda c, k: _let(by(k), lambda n: _moved(c, n, alphabets))), "")

            return F.struct(x["b"].alias("a"), _let(_digest(key, v["t"], i, x["b"]), moved).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(FEISTEL)), halves(v), step, lambda x: F.concat(x["a"], x["b"]))

    return _let(F.struct(tweak.alias("t"), text.alias("s")), rounds)


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(script: Column, make) -> Column:
    return F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))


def kind_of(entity: Column) -> Column:
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(entity.rlike(rf"^{IP}$"), "ip")
        .when(F.contains(entity, F.lit(":")), "ipv6")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(entity.rlike(rf"^{SSN}$"), "ssn")
        .when(entity.rlike(rf"^(?:{CARD})$"), "card")
        .when(entity.rlike(r"^\p{L}"), "name")
        .otherwise("phone")
    )


def atoms(entity: Column, kind: Column) -> Column:
    """The (kind, norm) parts of an entity that have surrogates of their own: the words of a name, an address and its host, else the whole.

    A phone's norm is its digits without the country code, which stays as it is.
    """
    digits = F.regexp_replace(entity, r"\D", "")
    words = F.split(F.regexp_replace(entity, r"^\p{L}+\.? ", ""), " ")
    gender = F.when(entity.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "given_f").otherwise("given_m")
    atom = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    surname = atom(F.lit("surname"), F.element_at(words, -1))
    names = F.when(F.size(words) > 1, F.array(atom(gender, words[0]), surname)).otherwise(F.array(surname))
    norm = (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "ip", entity)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(entity, r"^\+\d{1,3}(?=\D)", ""), r"\D", ""))
        .otherwise(digits)
    )
    mail = F.array(atom(kind, norm), atom(F.lit("host"), F.substring_index(norm, "@", -1)))
    return F.when(kind == "name", names).when(kind == "email", mail).otherwise(F.array(atom(kind, norm)))


def _luhn(digits: Column) -> Column:
    """Luhn sum (mod 10) of a digit string."""
    step = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, step(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _mod97(text: Column) -> Column:
    """Remainder of the number that digits and letters (A is 10) spell."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _network(norm: Column) -> Column:
    """The octets of an address that stay, with their last dot."""
    return F.regexp_extract(norm, r"^(?:192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|\d+\.)", 0)


def shape(kind: Column, norm: Column) -> Column:
    """(group, size): what the permutation of a norm keeps, and the log10 of how many strings share that; size is null where surrogates aren't permuted."""
    spelled = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    local = F.substring_index(norm, "@", 1)
    outline = F.regexp_replace(F.regexp_replace(local, r"\d", "0"), "[a-z]", "a")
    group = (
        F.when(kind.isin("phone", "ssn"), F.length(norm).cast("string"))
        .when(kind == "card", F.concat_ws("|", F.substring(norm, 1, 6), F.length(norm), _luhn(norm)))
        .when(kind == "ip", _network(norm))
        .when(kind == "ipv6", F.concat_ws("|", F.substring_index(norm, ":", 1), F.regexp_replace(norm, "[0-9a-f]", "0")))
        .when(kind == "iban", F.concat_ws("|", F.substring(norm, 1, 2), F.regexp_replace(F.regexp_replace(F.substring(norm, 5, 99), r"\d", "0"), "[A-Z]", "A")))
        .when(kind == "email", F.concat_ws("|", outline, F.substring_index(norm, "@", -1)))
    )
    size = (
        F.when(kind.isin("phone", "ssn"), F.length(norm))
        .when(kind == "card", F.length(norm) - 7)
        .when(kind == "ip", (4 - spelled(_network(norm), r"\.")) * F.log10(F.lit(256.0)))
        .when(kind == "ipv6", (spelled(norm, "[0-9a-f]") - F.length(F.substring_index(norm, ":", 1))) * F.log10(F.lit(16.0)))
        .when(kind == "iban", spelled(F.substring(norm, 5, 99), r"\d") + spelled(F.substring(norm, 5, 99), "[A-Z]") * F.log10(F.lit(26.0)))
        .when(kind == "email", spelled(local, r"\d") + spelled(local, "[a-z]") * F.log10(F.lit(26.0)))
    )
    return F.struct(group.alias("group"), size.cast("double").alias("size"))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate norm of an atom. ``attempt`` counts the surrogates that collisions have ruled out.

    An address keeps its host, for which the host's own surrogate stands in the text.
    """
    tweak = lambda *more: F.concat_ws("|", kind, attempt, *more)
    issuer = F.substring(norm, 1, 6)
    checked = lambda middle, luhn: F.concat(middle, F.pmod(luhn - _luhn(F.concat(middle, F.lit("0"))), F.lit(10)).cast("string"))
    middle = lambda luhn: F.concat(issuer, permuted(key, tweak(issuer, luhn), F.substring(norm, F.lit(7), F.length(norm) - 7)))
    card = _let(_luhn(norm), lambda luhn: _let(middle(luhn), lambda m: checked(m, luhn)))

    octets = lambda network: F.split(F.substring(norm, F.length(network) + 1, F.length(norm)), r"\.")
    hexed = lambda network: permuted(key, tweak(network), F.array_join(F.transform(octets(network), lambda o: F.lpad(F.lower(F.conv(o, 10, 16)), 2, "0")), ""), (_HEX,))
    spelled = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), (F.length(x) / 2).cast("int") - 1), lambda i: F.conv(F.substring(x, (2 * i + 1).cast("int"), F.lit(2)), 16, 10)), ".")
    ip = _let(_network(norm), lambda network: F.concat(network, _let(hexed(network), spelled)))
    group = F.substring_index(norm, ":", 1)
    ipv6 = F.concat(group, permuted(key, tweak(group), F.substring(norm, F.length(group) + 1, F.length(norm)), (_HEX,)))

    country, account = F.substring(norm, 1, 2), F.substring(norm, 5, 99)
    valid = lambda x: F.lit(98) - _mod97(F.concat(x, country, F.lit("00")))
    check = lambda other: F.pmod(valid(other) - valid(account) + F.substring(norm, 3, 2).cast("int"), F.lit(97))
    two = lambda n: F.lpad(F.when(n < 2, n + 97).otherwise(n).cast("string"), 2, "0")
    iban = _let(permuted(key, tweak(country), account), lambda other: F.concat(country, _let(check(other), two), other))

    syllable = lambda script, c: _by_script(script, lambda s: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), F.instr(F.lit(_HEX), c)))
    ending = {"given_f": dict(latin="na", cyrillic="на", greek="να"), "given_m": dict(latin="nor", cyrillic="нор", greek="νορ"), "surname": dict(latin="l", cyrillic="л", greek="λ")}
    tail = lambda script: reduce(lambda a, k: F.when(kind == k, _by_script(script, lambda s: F.lit(ending[k][s]))).otherwise(a), ending, F.lit(""))
    letters = F.split(F.substring(_digest(key, tweak(), norm), F.lit(1), F.lit(3) + attempt), "")
    name = _let(_script(norm), lambda script: F.initcap(F.concat(F.array_join(F.transform(letters, lambda c: syllable(script, c)), ""), tail(script))))

    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    rare = lambda c: c.rlike(r"^[\p{L}\p{N}]$") & ~c.rlike(rf"^[{''.join(ALPHABETS)}]$")
    common = lambda digest: F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(rare(c), F.translate(F.substring(digest, (i % 64 + 1).cast("int"), F.lit(1)), _HEX, LETTERS["latin"])).otherwise(c)), "")
    email = F.concat(permuted(key, tweak(domain), _let(_digest(key, tweak(), norm), common)), F.lit("@"), domain)
    host = F.concat(F.translate(F.substring(_digest(key, tweak(), norm), 1, HOST_LETTERS), _HEX, LETTERS["latin"]), F.lit(".example"))
    return (
        F.when(kind == "email", email)
        .when(kind == "host", host)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when(kind.isin("given_f", "given_m", "surname"), name)
        .otherwise(permuted(key, tweak(), norm))
    )


def _fill(entity: Column, kind: Column, made: Column) -> Column:
    """``entity`` with its last digits (an IBAN's letters, too) replaced by ``made``, punctuation and leading digits kept."""
    counts = lambda c: F.when(kind == "iban", c.rlike("^[A-Z0-9]$")).otherwise(c.rlike(r"^\d$"))
    own = F.when(kind == "iban", F.length(F.regexp_replace(entity, " ", ""))).otherwise(F.length(F.regexp_replace(entity, r"\D", "")))
    zero = F.struct(F.lit("").alias("out"), (F.length(made) - own).alias("k"))

    def step(a, c):
        k = F.when(counts(c), a["k"] + 1).otherwise(a["k"])
        return F.struct(F.concat(a["out"], F.when(counts(c) & (k > 0), F.substring(made, k, F.lit(1))).otherwise(c)).alias("out"), k.alias("k"))

    return F.aggregate(F.split(entity, ""), zero, step, lambda a: a["out"])


def _render(entity: Column, kind: Column, made: Column) -> Column:
    """The text that replaces an entity, of whose atoms ``made`` holds the surrogates."""
    title = F.regexp_extract(entity, r"^\p{L}+\.? ", 0)
    return F.when(kind == "name", F.concat(title, F.array_join(made, " "))).when(kind == "email", F.concat(F.substring_index(made[0], "@", 1), F.lit("@"), made[1])).when(kind.isin("ip", "ipv6"), made[0]).otherwise(_fill(entity, kind, made[0]))


def _found(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: F.struct(e.alias("text"), kind_of(e).alias("kind")))


def collisions(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(kind, norm, attempt), a table: the atoms of the corpus whose first surrogate another atom has, or is an atom itself.

    The smallest atom of a conflict keeps its surrogate, unless that is an atom; the others take their next
    ones, round by round, until none is in conflict with any. Shapes that are FULL stay out: there the
    permutation alone keeps surrogates distinct. A round handles the atoms in conflict only. Addresses are held
    against those of their host alone, since no made-up host is one of the corpus. No rows without entities.
    """
    scratch = Scratch(docs.sparkSession)
    atom = docs.select(F.explode(_found(F.col(text_col))).alias("e")).select(F.explode(atoms(F.col("e.text"), F.col("e.kind"))).alias("a")).select("a.*").distinct()
    made = lambda df, n: df.withColumns({"attempt": F.lit(n), "made": surrogate(key, F.col("kind"), F.col("norm"), F.lit(n))})
    every = scratch.keep(made(atom, 0).withColumn("shape", shape(F.col("kind"), F.col("norm"))), "atoms")
    used = every.groupBy("kind", "shape").agg(F.count("*").alias("n")).filter(F.log10("n") - F.log10(F.lit(FULL)) > F.col("shape.size"))
    free = every.join(used.select("kind", "shape"), ["kind", "shape"], "left_anti").select("kind", "norm", "attempt", "made")
    real = every.filter("kind <> 'email'").select("kind", F.col("norm").alias("made"))

    def clashing(df: DataFrame, *others: DataFrame) -> DataFrame:
        """The rows of ``df`` that share a surrogate with a smaller atom, or that ``others`` have."""
        several = df.groupBy("kind", "made").agg(F.min("norm").alias("least"), F.count("*").alias("n")).filter("n > 1")
        out = df.join(several, ["kind", "made"]).filter("norm <> least").select("kind", "norm")
        for other in others:
            out = out.union(df.join(other, ["kind", "made"]).select("kind", "norm"))
        return out.distinct()

    again = scratch.keep(clashing(free, real), "clashes")
    settled, tries = free.join(again, ["kind", "norm"], "left_anti").select("kind", "made"), None
    for n in range(1, MOST_ROUNDS + 1):
        if again.isEmpty():
            break
        moved = scratch.keep(made(again, n), "moved")
        again = scratch.keep(clashing(moved, real, settled), "clashes")
        kept = moved.join(again, ["kind", "norm"], "left_anti")
        settled = settled.union(kept.select("kind", "made"))
        tries = kept if tries is None else tries.union(kept)
    else:
        raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} rounds")
    none = every.filter("false") if tries is None else tries
    out = materialize(none.select("kind", "norm", "attempt"), "tries")
    scratch.drop()
    return out


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_email, n_ip, n_ssn, n_phone, n_card, n_name, n_ipv6, n_iban, changed) for each row of ``docs``.

    Null texts stay null and have no entities; rows without entities keep their texts. Names are recognised
    after a title, so that words which merely look like names stay; the words of a recognised name are then
    replaced wherever the same text has them, by the same surrogates. Texts are read whole; repeated rows give
    equal results, an empty table gives none, and other columns play no part.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tries = collisions(plain, "text", key).withColumn("atom", F.concat_ws(":", "kind", "norm"))
    entry = F.struct("atom", "attempt")
    if tries.count() <= MOST_INLINE:  # so the one row is bounded
        held = plain.crossJoin(F.broadcast(tries.agg(F.map_from_entries(F.collect_list(entry)).alias("tries"))))
    else:
        of = lambda df: df.withColumn("h", F.xxhash64("text"))
        used = of(plain).select("id", "h", F.explode(_found(F.col("text"))).alias("e")).select("id", "h", F.explode(atoms(F.col("e.text"), F.col("e.kind"))).alias("a"))
        asked = used.select("id", "h", F.concat_ws(":", "a.kind", "a.norm").alias("atom")).distinct()
        mine = salted_join(asked, tries.select("atom", "attempt"), "atom").groupBy("id", "h").agg(F.map_from_entries(F.collect_set(entry)).alias("tries"))
        mine = mine.withColumnsRenamed({"id": "i", "h": "g"})
        held = of(plain).join(mine, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select("id", "text", F.coalesce("tries", F.create_map().cast("map<string,int>")).alias("tries"))
    marked = held.withColumn("found", F.coalesce(_found(F.col("text")), F.array().cast("array<struct<text:string,kind:string>>")))
    attempt = lambda a: F.coalesce(F.try_element_at("tries", F.concat_ws(":", a["kind"], a["norm"])), F.lit(0))
    one = lambda a: F.struct(a["norm"].alias("norm"), surrogate(key, a["kind"], a["norm"], attempt(a)).alias("made"))
    marked = marked.withColumn("made", F.transform("found", lambda e: F.transform(atoms(e["text"], e["kind"]), one)))
    new = F.zip_with("found", "made", lambda e, m: _let(F.transform(m, lambda x: x["made"]), lambda x: _render(e["text"], e["kind"], x)))
    known = F.flatten(F.zip_with("found", "made", lambda e, m: F.when(e["kind"] == "name", m).otherwise(F.slice(m, F.lit(1), F.lit(0)))))
    marked = marked.withColumns({"new": new, "known": known})

    def renamed(part: Column) -> Column:
        """Text between entities, the words of the text's own names replaced."""
        word = r"\p{L}[\p{L}'-]*"
        other = lambda w: F.coalesce(F.try_element_at(F.filter("known", lambda k: k["norm"] == w), F.lit(1))["made"], w)
        words = F.transform(F.regexp_extract_all(part, F.lit(word), F.lit(0)), other)
        return F.array_join(F.flatten(F.zip_with(F.split(part, word, -1), words, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

    between = F.split("text", ENTITY, -1)
    between = F.when(F.size("known") > 0, F.transform(between, renamed)).otherwise(between)
    text = F.when(F.size("found") > 0, F.array_join(F.flatten(F.zip_with(between, "new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter("found", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return marked.select("id", text.alias("text"), *map(count, KINDS), (F.size("found") > 0).alias("changed"))
