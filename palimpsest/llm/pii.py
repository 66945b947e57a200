"""Surrogates for personal data, in DataFrame functions alone.

Entities are found by expressions: e-mail addresses, IPv4 addresses, payment cards, social security
numbers, telephone numbers, and names: after a title, after words that announce one, or a listed given name with a
surname. Where a text has named a person once, the person's given name and surname go wherever they stand
alone in it, each with the surrogate that it has in the full name. Each entity is replaced by a keyed surrogate of the
same type and format: digits stay digits in the same places, letters stay letters of the same script
and case, a card keeps whether its check digit holds, an address its class of first octet, a listed
given name becomes one of the same gender, and any other name keeps its title and its ending, which
carries the gender.

Distinctness holds by construction, so that no table of entities has to be shuffled: every type is
mapped by a keyed permutation over the entities of one format: a Feistel network, then one digit or
letter moved on, then the network backwards. So it is a bijection, and no entity stands for itself,
however many of a small format there are. As the map depends on nothing but key and entity, an entity has the same surrogate in
every document (coreference), in whatever case or punctuation it is written. ``collisions`` checks
both over a corpus: it lists surrogates that stand for more than one entity. What has no letter or
digit of ALPHABETS becomes letters drawn from its keyed hash. The key is the session's
``spark.palimpsest.surrogate.key``; the default is for tests, and as public as this file.

Defined results: a null text stays null, an empty one empty; texts without entities stay as they
are; of a name its first mention with a title, a listed given name or an announcement counts in ``n_entities``,
what stands alone doesn't; repeated rows are treated alike; an empty table gives none; further columns pass through, but for
one called ``n_entities``, which the result replaces. Very long texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY, KEY_SETTING = "palimpsest", "spark.palimpsest.surrogate.key"
#: Titles by gender, and given names by gender; the lists are the range of surrogates, too.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra"), "m": ("Mr", "Herr", "Sr", "Sir")}
NAMES = {
    "f": ("Alice", "Anna", "Beatriz", "Carla", "Claire", "Diana", "Elena", "Emma", "Greta", "Helena", "Ines", "Julia", "Laura", "Louise", "Maria", "Marta", "Nina", "Olivia", "Paula", "Rosa", "Sarah", "Sofia"),
    "m": ("Adam", "Bruno", "Carlos", "David", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "James", "John", "Jorge", "Karl", "Louis", "Mark", "Martin", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor"),
}
#: Letters of a script and case; a letter is only ever replaced by one of its own line.
_COMMON = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)


def _further(known: str) -> list[str]:
    """The other letters that have two cases, by script and row of 128, upper and lower case aligned."""
    rows = defaultdict(list)
    for c in map(chr, range(0xC0, 0x2C00)):
        low = c.lower()
        if c not in known and low not in known and len(low) == 1 and low.upper() == c and (unicodedata.category(c), unicodedata.category(low)) == ("Lu", "Ll"):
            rows[unicodedata.name(c).split()[0], ord(c) >> 7].append((low, c))
    return ["".join(x) for row in rows.values() if len(row) > 1 for x in zip(*row, strict=True)]


ALPHABETS = (*_COMMON, *_further("".join(_COMMON)))
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(x for xs in NAMES.values() for x in xs)
#: What announces a name.
SAID = ("[Mm]y name is", "[Nn]ame:", "[Dd]ear", "[Ss]igned by", "[Rr]egards,", "[Ss]incerely,")
_CAPITAL = r"\p{Lu}\p{Ll}+"
#: In the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9À-ÖØ-öø-ÿ](?:[\w.+À-ÖØ-öø-ÿ-]{0,62}[\wÀ-ÖØ-öø-ÿ])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,6}[A-Za-z]{2,18}(?![\w@])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|[.-]\d)",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w]|[.-]\d)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w]|[.-]\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w]|[.-]\d)",
    "name": rf"(?<!\w)(?:{_TITLE})\.?\x20{_CAPITAL}(?:\x20{_CAPITAL})?(?!\w)|(?<![\p{{L}}\w])(?:{_GIVEN})\x20{_CAPITAL}(?!\w)|(?<=\b(?:{'|'.join(SAID)})\x20){_CAPITAL}(?:\x20{_CAPITAL})?(?!\w)",
}
PATTERN = "|".join(KINDS.values())
#: The text that any entity has somewhere; what lacks it isn't searched.
HINT = rf"@|\d\d|\d\.\d\.|\b(?:{_TITLE}|{'|'.join(SAID)})(?!\w)|\b(?:{_GIVEN})\x20\p{{Lu}}"
#: A word by itself.
_ALONE = r"(?<![\p{L}\p{N}_])(?=\p{Lu})(?:%s)(?![\p{L}\p{N}_])"


def _hash(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number, of SHA-256 over the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once and written once, which keeps plans small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _fold(start: Column, step, finish, back: bool = False) -> Column:
    """Six rounds of a Feistel network over a struct (a, b), or the same undone; ``step(a, b, i, sign)``
    gives what a becomes under b, and with sign -1 what it was. Each round is computed once."""
    if back:
        return F.aggregate(F.sequence(F.lit(6), F.lit(1)), start, lambda x, i: F.struct(step(x["b"], x["a"], i, -1).alias("a"), x["a"].alias("b")), finish)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda x, i: F.struct(x["b"].alias("a"), step(x["a"], x["b"], i, 1).alias("b")), finish)


def _rounds(text: Column, step, moved) -> Column:
    """A keyed permutation of strings without fixed points: the network over a string's halves, then
    ``moved``, a permutation without fixed points, then the network backwards."""

    def pair(t):
        half = F.floor(F.length(t) / 2).cast("int")
        return F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t) - half).alias("b"))

    def joined(x):
        return F.concat(x["a"], x["b"])

    return _let(_let(_fold(pair(text), step, joined), moved), lambda x: _fold(pair(x), step, joined, back=True))


def _drawn(text: Column, key: str, kind: str, n: int = 12) -> Column:
    """``n`` letters from a keyed hash, the first a capital: for what has nothing to permute."""
    return F.initcap(F.translate(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), text), 256), 1, n), "0123456789abcdef", "abcdefghijklmnop"))


def _next(text: Column) -> Column:
    """The string with its first letter or digit replaced by the next of its alphabet, in a circle."""
    every, turned = "".join(ALPHABETS), "".join(x[1:] + x[0] for x in ALPHABETS)
    before = F.length(F.regexp_extract(text, f"^[^{every}]*", 0))
    return F.concat(F.substring(text, F.lit(1), before), F.translate(F.substring(text, before + 1, F.lit(1)), every, turned), F.substring(text, before + 2, F.length(text)))


def _digits(text: Column, key: str, kind: str) -> Column:
    """A keyed bijection of digit strings of one length (to 36) onto themselves, without fixed points."""

    def step(a, b, i, sign):
        size = F.rpad(F.lit("1"), F.length(a) + 1, "0").cast("long")
        number = F.when(F.length(a) == 0, "0").otherwise(a).cast("long")
        new = F.pmod(number + sign * _hash(key, F.lit(kind), i.cast("string"), F.length(a).cast("string"), b), size)
        return F.when(F.length(a) == 0, F.lit("")).otherwise(F.lpad(new.cast("string"), F.length(a), "0"))

    return _rounds(text, step, _next)


#: Where each alphabet starts among all letters, and how many it has; as SQL, which is one call to build.
_STARTS = [1 + sum(map(len, ALPHABETS[:k])) for k in range(len(ALPHABETS))]
_LINES = "array(" + ", ".join(f"named_struct('start', {x}, 'n', {len(y)})" for x, y in zip(_STARTS, ALPHABETS, strict=True)) + ")"


def _strings(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{x}'" for x in values) + ")")


def _shift(text: Column, by: Column, sign: int) -> Column:
    """Each letter or digit moved within its alphabet by a number drawn from ``by`` and its place."""

    every, lines = "".join(ALPHABETS), F.expr(_LINES)

    def one(c, i):
        def moved(at):
            line = F.element_at(F.filter(lines, lambda x: x["start"] <= at), -1)
            return F.when(at == 0, c).otherwise(_let(line, lambda x: F.substring(F.lit(every), (x["start"] + F.pmod(at - x["start"] + sign * F.pmod(_hash("", by, i.cast("string")), x["n"]), x["n"])).cast("int"), F.lit(1))))

        return _let(F.position(c, F.lit(every)), moved)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _letters(text: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """A keyed bijection of strings that keeps length, scripts and case, without fixed points; case
    doesn't change the rest."""
    more = [] if tweak is None else [tweak]

    def step(a, b, i, sign):
        return _shift(a, F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), i.cast("string"), F.lower(b), *more), 256), sign)

    return _rounds(text, step, _next)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one after another, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(x, c):
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(x["out"], F.when(digit, F.substring(digits, x["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, x["k"] + 1).otherwise(x["k"]).alias("k"))

    return F.aggregate(F.split(shape, ""), start, put, lambda x: x["out"])


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(head: Column) -> Column:
    """The check digit of a card number's other digits."""
    places = F.filter(F.split(F.reverse(head), ""), lambda c: c != "")
    total = F.aggregate(F.transform(places, lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int")), F.lit(0), lambda x, y: x + y)
    return F.pmod(-total, F.lit(10))


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    last = F.substring(digits, F.length(digits), F.lit(1)).cast("int")

    def filled(new):
        return _refill(m, F.concat(new, F.pmod(_luhn(new) + last - _luhn(head), F.lit(10)).cast("string")))

    return _let(_digits(head, key, "card"), filled)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    start = F.struct((octets[1] * 16 + F.floor(octets[2] / 16)).cast("long").alias("a"), (octets[2] % 16 * 256 + octets[3]).cast("long").alias("b"))

    def step(a, b, i, sign):
        return F.pmod(a + sign * _hash(key, F.lit("ip"), i.cast("string"), b.cast("string")), F.lit(4096))

    def moved(x):
        return _fold(F.struct(F.pmod(x["a"] + 1, F.lit(4096)).alias("a"), x["b"].alias("b")), step, lambda y: y, back=True)

    low = _let(_fold(start, step, lambda x: x), moved)
    first = octets[0]
    for least, most in ((1, 126), (128, 191), (192, 223)):
        n = most - least + 1
        first = F.when(octets[0].between(least, most), F.pmod(octets[0] - least + F.pmod(_hash(key, F.lit(f"ip{least}")), F.lit(n - 1)) + 1, F.lit(n)) + least).otherwise(first)
    return _let(low, lambda x: F.concat_ws(".", first.cast("int"), F.floor(x["a"] / 16), x["a"] % 16 * 16 + F.floor(x["b"] / 256), x["b"] % 256))


def _country(m: Column) -> Column:
    """The part of a telephone number that surrogates keep: +1 before ten digits, what stands before
    the first mark, or three digits."""
    return F.regexp_extract(m, r"^\+(?:1(?=\d{10}$)|\d{1,3}(?=[ .(-])|\d{3})", 0)


def _subscriber(m: Column) -> Column:
    return _only_digits(F.substring(m, F.length(_country(m)) + 1, F.length(m)))


def _phone(m: Column, key: str) -> Column:
    country = _country(m)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    digits = _subscriber(m)

    def reserved(x):  # an exchange that has no subscribers stays one, and none else becomes one
        return (F.length(x) == 10) & (F.substring(x, 4, 3) == "555")

    def filled(x):
        new = _digits(F.concat(F.substring(x, 1, 3), F.substring(x, 7, 4)), key, "phone")
        kept = _let(new, lambda y: F.concat(F.substring(y, 1, 3), F.lit("555"), F.substring(y, 4, 4)))
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(6)), x, lambda y, i: F.when((i == 1) | reserved(y), _digits(y, key, "phone")).otherwise(y))
        return _refill(rest, F.when(reserved(x), kept).otherwise(walk))

    return F.concat(country, _let(digits, filled))


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tail = F.regexp_extract(domain, r"(?i)((?:^|\.)example\.(?:com|org|net)|\.[a-z]+)$", 1)
    head = F.substring(domain, F.lit(1), F.length(domain) - F.length(tail))
    new = F.concat(_letters(local, key, "email", F.lower(domain)), F.lit("@"), _letters(head, key, "domain", F.lower(tail)), tail)
    return _let(new, lambda x: F.when(x == m, F.concat(F.lower(_drawn(m, key, "email")), F.lit("@"), domain)).otherwise(x))


def _word(w: Column, key: str) -> Column:
    listed = _strings(x for xs in NAMES.values() for x in xs)

    def moved(x):  # all but the ending, under a key of that ending
        cut = F.when(F.length(x) > 2, F.length(x) - 1).otherwise(F.length(x))
        end = F.substring(x, cut + 1, F.lit(1))
        return F.concat(_letters(F.substring(x, F.lit(1), cut), key, "name", F.lower(end)), end)

    # walks on until it is outside the lists, so that no unlisted name becomes a listed one
    out = F.aggregate(F.sequence(F.lit(1), F.lit(8)), w, lambda x, i: F.when((i == 1) | F.array_contains(listed, x), moved(x)).otherwise(x))
    out = _let(out, lambda x: F.when(x == w, _drawn(w, key, "name")).otherwise(x))
    for gender, xs in NAMES.items():
        names, n = _strings(xs), F.lit(len(xs))
        at = F.array_position(names, w)
        out = F.when(at > 0, F.element_at(names, (F.pmod(at - 1 + 1 + F.pmod(_hash(key, F.lit(gender)), n - 1), n) + 1).cast("int"))).otherwise(out)
    return out


def _named(m: Column) -> Column:
    """The words of a name, without its title."""
    return F.split(F.regexp_replace(m, rf"^(?:{_TITLE})\.?\x20", ""), " ")


def _name(m: Column, key: str) -> Column:
    return F.concat(F.regexp_extract(m, rf"^(?:(?:{_TITLE})\.?\x20)?", 0), F.array_join(F.transform(_named(m), lambda w: _word(w, key)), " "))


def kind_of(m: Column) -> Column:
    """The kind of an entity that PATTERN has found."""
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(m.rlike(r"^\p{Lu}\p{Ll}+\.?(?:\x20|$)"), "name")
        .when(m.rlike(r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})$"), "card")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .otherwise("phone")
    )


def surrogate(m: Column, key: str = KEY) -> Column:
    """What stands for an entity. The same entity has the same surrogate everywhere."""
    return _let(
        kind_of(m),
        lambda kind: F.when(kind == "email", _email(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "name", _name(m, key))
        .when(kind == "card", _card(m, key))
        .when(kind == "ssn", _refill(m, _digits(_only_digits(m), key, "ssn")))
        .otherwise(_phone(m, key)),
    )


def canonical(m: Column) -> Column:
    """An entity without its case and punctuation; a name without its title, a number without its country."""

    def plain(kind):
        digits = F.when(kind.isin("card", "ssn"), _only_digits(m)).when(kind == "phone", _subscriber(m))
        return digits.when(kind == "name", F.array_join(_named(m), " ")).otherwise(F.lower(m))

    return _let(kind_of(m), plain)


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


#: Stands around entities while they are cut out; a text that has it is cut in two passes.
_MARK = "\ufdd0"


def pieces(text: Column) -> Column:
    """The text in pieces, every second one an entity; null where no entity can be."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda gap, m: F.array_compact(F.array(gap, m))))
    return F.when(text.rlike(HINT), F.when(F.contains(text, F.lit(_MARK)), apart).otherwise(marked))


def replaced(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the number of entities in ``n_entities``."""
    mine = next(x for x in (f"_pieces{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    cut = docs.withColumn(mine, pieces(F.col(text_col)))
    names = F.filter(mine, lambda x, i: (i % 2 == 1) & (kind_of(x) == "name"))
    words = F.array_distinct(F.flatten(F.transform(names, _named)))

    def again(x, alone):
        """What lies between entities, with the names that the text has given replaced where they stand alone."""
        found = F.regexp_extract_all(x, alone, F.lit(0))
        return F.when(F.size(found) == 0, x).otherwise(F.array_join(F.zip_with(F.split(x, alone, -1), found, lambda gap, w: F.concat(gap, F.when(w.isNull(), "").otherwise(_word(w, key)))), ""))

    def joined(ws):
        alone = F.format_string(_ALONE.replace("%s", "%1$s"), F.array_join(ws, "|"))
        return F.array_join(F.transform(mine, lambda x, i: F.when(i % 2 == 1, surrogate(x, key)).when(F.size(ws) == 0, x).otherwise(again(x, alone))), "")

    new = _let(words, joined)
    n = F.when(F.col(mine).isNull(), 0).otherwise(F.floor(F.size(mine) / 2))
    return cut.withColumn(text_col, F.when(n > 0, new).otherwise(F.col(text_col))).withColumn("n_entities", n.cast("long")).drop(mine)


def collisions(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """(kind, surrogate, n): surrogates that would stand for n > 1 entities of the corpus, or (n = 0) for
    themselves, as what has no letter or digit of ALPHABETS does. Entities are made distinct before they
    are shuffled."""
    seen = docs.select(F.explode(entities(F.col(text_col))).alias("m")).distinct()
    pairs = seen.select(kind_of(F.col("m")).alias("kind"), canonical(F.col("m")).alias("entity"), _let(surrogate(F.col("m"), key), canonical).alias("surrogate")).distinct()
    by = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max(F.col("entity") == F.col("surrogate")).alias("same"))
    return by.where("n > 1 or same").select("kind", "surrogate", F.when(F.col("same"), 0).otherwise(F.col("n")).alias("n"))


def pseudonymized(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``replaced`` under the first of the keys ``key``, ``key/1``, ... under which no two entities of the
    corpus share a surrogate and none stands for itself; an error if eight of them don't do.

    By construction the first key serves; the check is one pass over the distinct entities.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    for i in range(8):
        now = key if i == 0 else f"{key}/{i}"
        if collisions(docs, text_col, now).limit(1).count() == 0:
            return replaced(docs, text_col, now)
    raise ValueError("every key tried gives collisions")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")
