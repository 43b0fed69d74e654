"""Personal data: detected entities are replaced by keyed surrogates of the same kind.

* *Detection* by one pattern: e-mail addresses, titled names, secrets, card numbers, account numbers (IBAN), phone numbers,
  social security numbers, IPv4 and IPv6 addresses.  Names without a title are not found.
* *Surrogates* depend on the key, the type and the entity (digits compared without format; a phone number without a
  country code is one of ``country``), so one entity has one surrogate in all texts (coreference).  A surrogate has the
  type's format: a phone keeps its punctuation and country code, a card or account number with right check digits gets such,
  a private address stays private, a name keeps its title, gender and script, a mention its capitals.
* *Collision checks*: surrogates of all entities are compared with each other and with all real entities of the
  type; losers (all but the smallest entity) are drawn anew until none collides, so different entities stay different.

Texts are dealt out once, by document: what meets the entities' surrogates is the mentions, without the texts between them.

Defined results: null text stays null, texts without entities stay as they are, repeated rows stay repeated,
any column may be null, and an empty table gives an empty one.  All of it is DataFrame expressions; only texts with
entities are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Господин|Госпожа"
_NAME = r"\p{Lu}(?:\p{L}+|['’]\p{L}+)(?:['’\-]\p{L}+)*+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# The entity patterns, the first that fits a place wins.  A domain has at most 127 parts; other repeats of groups are possessive or
# counted, as an open one takes a stack frame for each part and a long text has many.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+\-@])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.){1,126}\p{L}{2,}",
    "name": rf"\b(?:{TITLES})\.? {_NAME}(?: {_NAME})?(?!\p{{L}})",
    "secret": r"(?<![\p{L}\p{N}_\-])(?:(?:sk|pk|ghp|AKIA)[_\-]?[A-Za-z0-9]{16,}|[0-9a-fA-F]{32,})(?![\p{L}\p{N}_\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){3}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,8}){2,4}|0[0-9]{2,4}[ /\-][0-9]{6,8})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
}
ANY = "|".join(PATTERNS.values())
#: For each pattern what every match of it holds, so a text without any of these has no entity.
HINTS: dict[str, str] = {
    "email": "@",
    "name": rf"\b(?:{TITLES})\.? \p{{Lu}}",
    "secret": r"(?:sk|pk|ghp|AKIA)[_\-]?[A-Za-z0-9]{16}|[0-9a-fA-F]{32}",
    "iban card phone ssn ip": "[0-9]",
    "ipv6": "[0-9a-fA-F]:[0-9a-fA-F:]",
}
HINT = "|".join(HINTS.values())
TITLE = rf"^(?:{TITLES})\.? "
# Country codes of one and two digits; all others have three.
_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[1-9][0-9]{2})"
# Names by script and gender.
FIRST = {
    "latin_f": "Ada Beth Carla Dora Elsa Fiona Grace Hanna Iris Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tess Vera".split(),
    "latin_m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Noah Oscar Paul Ralf Simon Tom Victor".split(),
    "cyrillic_f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег".split(),
}
LAST = {
    "latin": "Abel Berger Conte Dahl Ernst Falk Gruber Holm Ibsen Jansen Keller Lund Moreau Navarro Olsen Perrin Quist Romero Sander Torres".split(),
    "cyrillic_f": "Белова Волкова Громова Дубова Ершова Зимина Котова Лосева Морозова Носова".split(),
    "cyrillic_m": "Белов Волков Громов Дубов Ершов Зимин Котов Лосев Морозов Носов".split(),
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Madame|Госпожа)\b"
NEUTRAL = r"^(?:Dr|Prof)\b"


def _type_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        # The pattern that starts the match of the union is the first that fits all of the mention.
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _norm(kind: Column, mention: Column, country: str) -> Column:
    """What makes mentions the same entity; a name's gender stays part of it, and a secret's capitals."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    gender = F.when(mention.rlike(FEMALE), "f:").when(mention.rlike(NEUTRAL), "n:").otherwise("m:")
    return (
        F.when((kind == "phone") & ~mention.startswith("+") & ~digits.startswith("0"), F.concat(F.lit(country), digits))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "name", F.concat(gender, F.lower(F.regexp_replace(mention, TITLE, ""))))
        .when(kind == "secret", mention)
        .otherwise(F.lower(F.regexp_replace(mention, " ", "")))
    )


def _luhn(digits: Column) -> Column:
    """The sum of a card number's digits, every second one from the right doubled, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10


def _mod97(letters: Column) -> Column:
    """An account number as digits (a is 10, b is 11 ...), modulo 97."""
    value = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87))
    return F.aggregate(value, F.lit(0), lambda acc, x: (acc * F.when(x < 10, 10).otherwise(100) + x) % 97)


def _pick(values: list[str], hexes: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.conv(hexes, 16, 10).cast("long") % len(values) + 1).cast("int"))


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The replacement of an entity, in lower case where case is the mention's."""
    hx = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    more = F.sha2(F.concat(hx, F.lit("+")), 256)
    digits, letters = F.translate(F.concat(hx, more), "abcdef", "052963"), F.translate(F.concat(hx, more), "0123456789", "ghijklmnop")
    at = lambda s, i: F.substr(s, (F.pmod(i, F.lit(128)) + 1).cast("int"), F.lit(1))
    shaped = F.array_join(
        F.transform(
            F.split(F.substring_index(norm, "@", 1), ""),
            lambda c, i: F.when(c.rlike("[0-9]"), at(digits, i))
            .when(c.rlike(r"\p{IsCyrillic}"), F.translate(at(letters, i), "abcdefghijklmnop", "абвгдежзиклмнопр"))
            .when(c.rlike(r"\p{L}"), at(letters, i))
            .otherwise(c),
        ),
        "",
    )
    tail = F.when(attempt > 0, attempt.cast("string")).otherwise("")
    domain = F.substring_index(norm, "@", -1)
    host = F.concat(F.lit("mail"), F.substr(F.sha2(F.concat_ws("|", F.lit(key), domain), 256), F.lit(1), F.lit(6)), F.lit(".example."), F.substring_index(domain, ".", -1))
    octet = lambda i: (F.conv(F.substr(hx, F.lit(i), F.lit(6)), 16, 10).cast("long") % 254 + 1).cast("string")
    secret = F.concat(F.regexp_extract(norm, r"^((?:sk|pk|ghp|AKIA)[_\-]?)?", 0), F.substr(F.repeat(F.concat(hx, more), F.ceil(F.length(norm) / 128).cast("int")), F.lit(1), F.length(norm)))
    # The code of a phone's country stays, and what follows it begins like a number that can be dialled.
    code = F.when(norm.startswith("0"), "0").otherwise(F.regexp_extract(norm, _CODE, 0))
    dialled = lambda n: F.concat(F.translate(F.substr(digits, F.lit(1), F.lit(1)), "01", "27"), F.substr(digits, F.lit(2), n - 1))
    card = F.substr(digits, F.lit(1), F.length(norm) - 1)
    valid = F.concat(card, F.pmod(-_luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string"))
    body = F.array_join(
        F.transform(F.split(F.substr(norm, F.lit(5), F.length(norm)), ""), lambda c, i: F.when(c.rlike("[0-9]"), at(digits, i)).when(c != "", at(letters, i)).otherwise("")), ""
    )
    land = F.substr(norm, F.lit(1), F.lit(2))
    account = F.concat(land, F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body)
    private = F.regexp_extract(norm, r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 0)
    public = F.concat(F.element_at(F.array(*[F.lit(str(x)) for x in (11, 23, 45, 62, 81, 94, 108, 133, 151, 176, 188, 203)]), (F.conv(F.substr(hx, F.lit(1), F.lit(6)), 16, 10).cast("long") % 12 + 1).cast("int")), F.lit("."))
    fixed = F.when(private != "", private).otherwise(public)
    rest = F.slice(F.array(octet(8), octet(15), octet(22)), 1, 4 - F.size(F.split(fixed, r"\.")) + 1)
    # The first two digits of an IPv6 address tell its scope and stay.
    wide = F.concat(land, F.array_join(F.transform(F.split(F.substr(norm, F.lit(3), F.length(norm)), ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(hx, (F.pmod(i, F.lit(64)) + 1).cast("int"), F.lit(1))).otherwise(c)), ""))
    female = norm.startswith("f:") | (norm.startswith("n:") & hx.rlike("[0-7]$"))
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    first = F.substr(hx, F.lit(1), F.lit(8))
    last = F.substr(hx, F.lit(9), F.lit(8))
    pick = lambda table, suffix="": F.when(cyrillic & female, _pick(table["cyrillic_f"], suffix)).when(cyrillic, _pick(table["cyrillic_m"], suffix))
    given = pick(FIRST, first).when(female, _pick(FIRST["latin_f"], first)).otherwise(_pick(FIRST["latin_m"], first))
    family = pick(LAST, last).otherwise(_pick(LAST["latin"], last))
    # Names come from short lists: each further attempt adds initials, so there is always a free name.
    initials = F.when(attempt > 0, F.concat(F.lit(" "), F.upper(F.substr(F.regexp_replace(letters, "[^g-p]", ""), F.lit(1), attempt.cast("int"))))).otherwise("")
    two = norm.contains(" ")
    return (
        F.when(kind == "email", F.concat(shaped, tail, F.lit("@"), host))
        .when(kind == "phone", F.concat(code, dialled(F.length(norm) - F.length(code))))
        .when(kind == "ssn", dialled(F.length(norm)))
        .when(kind == "card", F.when(_luhn(norm) == 0, valid).otherwise(F.substr(digits, F.lit(1), F.length(norm))))
        .when(kind == "iban", F.when(_mod97(F.concat(F.substr(norm, F.lit(5), F.length(norm)), F.substr(norm, F.lit(1), F.lit(4)))) == 1, account).otherwise(F.concat(land, F.substr(digits, F.lit(1), F.lit(2)), body)))
        .when(kind == "ip", F.concat(fixed, F.array_join(rest, ".")))
        .when(kind == "ipv6", wide)
        .when(kind == "secret", F.substr(secret, F.lit(1), F.length(norm)))
        .when(kind == "name", F.concat(given, initials, F.when(two, F.concat(F.lit(" "), family)).otherwise("")))
    )


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format."""
    # Digits from the right, so a mention without the country code gets the surrogate's others.
    left = lambda i: F.length(F.regexp_replace(F.substr(mention, i + 1), "[^0-9]", ""))
    digits = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(c.rlike("[0-9]") & (left(i) <= F.length(surrogate)), F.substr(surrogate, F.length(surrogate) - left(i) + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )
    upto = lambda i: F.length(F.replace(F.substr(mention, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    account = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c == " ", c).otherwise(F.upper(F.substr(surrogate, upto(i), F.lit(1))))), "")
    cased = lambda m, s: F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(s)).otherwise(s)
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", account)
        .when(kind == "name", F.concat(F.regexp_extract(mention, TITLE, 0), cased(F.regexp_replace(mention, TITLE, ""), surrogate)))
        .when(kind == "secret", surrogate)
        .otherwise(cased(mention, surrogate))
    )


def _resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities (kind, norm), with different surrogates that are no real entity."""
    now = written(entities.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))), "entities")
    plain = lambda c: F.regexp_replace(F.lower(c), r"^[fmn]:", "")
    while True:
        taken = now.groupBy("kind", F.lower("surrogate").alias("s")).agg(F.min("norm").alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = taken.where("n > 1").select("kind", "s", "owner")
        real = now.select("kind", plain(F.col("norm")).alias("s")).distinct()
        clash = shared.union(taken.join(real, ["kind", "s"], "left_semi").select("kind", "s", F.lit(None).cast("string")))
        clash = clash.groupBy("kind", "s").agg(F.when(F.count("owner") == F.count(F.lit(1)), F.min("owner")).alias("owner"))
        clash = written(clash, "clashes")
        if clash.isEmpty():
            return now.select("kind", "norm", "surrogate")
        lost = F.col("c.s").isNotNull() & ~F.coalesce(F.col("c.owner") == F.col("norm"), F.lit(False))
        e = now.alias("e").join(clash.alias("c"), (F.col("e.kind") == F.col("c.kind")) & (F.lower("e.surrogate") == F.col("c.s")), "left")
        e = e.select("e.kind", "e.norm", (F.col("e.attempt") + lost.cast("int")).alias("attempt"))
        now = written(e.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))), "entities")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), key: str = "quern", country: str = "1") -> DataFrame:
    """(doc_id, text, n_entities, *keep): every row of ``docs`` with its entities replaced.

    keep: further columns to carry.  ``key`` selects the surrogates; without it they cannot be traced back by trying entities.
    country: the code of phone numbers that have none.
    """
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = rows.select("*", F.when(hint, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("found"))
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    marked = written(found.where(has).withColumn("h", F.xxhash64("text")), "with-entities")
    each = marked.select("doc_id", "h", F.posexplode("found").alias("at", "mention"))
    each = each.withColumn("kind", _type_of(F.col("mention"))).withColumn("norm", _norm(F.col("kind"), F.col("mention"), country))
    # An entity that very many texts mention meets the join as many short rows; adaptive execution splits them.
    surrogates = _resolved(each.where("kind is not null").select("kind", "norm").distinct(), key)
    each = each.join(surrogates, ["kind", "norm"], "left")
    new = F.coalesce(_rendered(F.col("kind"), F.col("mention"), F.col("surrogate")), "mention")
    # Equal rows (of one id and text) have equal mentions, so a set holds each of them once.
    again = each.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("at", new.alias("new")))).alias("new"))
    met = marked.alias("m").join(again.alias("a"), F.col("m.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("m.h") == F.col("a.h")))
    pieces = F.zip_with(F.split("text", ANY, -1), "new", lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit(""))))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    plain = found.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities"), *names)
    return plain.union(met.select("m.doc_id", F.array_join(pieces, "").alias("text"), F.size("found").alias("n_entities"), *names))
