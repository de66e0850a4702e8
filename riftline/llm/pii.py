r"""PII surrogates: keyed, type-consistent replacements of the same format.

Native: one regular expression cuts a text into matches and what lies between, and each match is rewritten in its row, so texts never shuffle.

A surrogate is an online cipher of the match: each character moves within its own class (digit, lower or upper case letter of a script, octet of an
address) by a keyed hash of the characters before it. The key is the session's spark.riftline.pii.key, a number; the hash is fast, not cryptographic. So equal entities get equal surrogates anywhere (coreference), different ones of a type get
different ones (the cipher can be undone character by character), and length, case, script and punctuation stay. Given names move within a list of
their gender and script, never to themselves; a surname's ending that tells the gender stays, as do country codes and the marks of access keys. That no surrogate is itself an entity of the corpus, or another's surrogate, is checked over all entities; those that fail
are enciphered anew, alone, until none is left.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import table, written

#: Given names by gender and script. Fixed values.
GIVEN = (
    ("James", "Robert", "Michael", "David", "William", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Pierre", "Jean", "Hans", "Karl", "Carlos", "Juan", "José", "John", "Paul", "Peter", "Jürgen", "François"),
    ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Marie", "Sophie", "Anna", "Greta", "Carmen", "Lucia", "María", "Emily", "Laura", "Zoë"),
    ("Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Михаил", "Николай", "Павел", "Пётр", "Фёдор"),
    ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
)
KINDS = {
    "email": r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2} ?[0-9A-Z]{4}(?: ?\d{4}){2,6}(?: ?[0-9A-Z]{1,4})?(?!\w)",
    "key": r"(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_](?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}+)(?!\w)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\w)",
    "secret": r"(?<![\w])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+(?![\w])",
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])",
    "name": r"(?<![\p{L}])(?:" + "|".join(n for names in GIVEN for n in names) + r") \p{Lu}\p{Ll}++(?![\p{L}])",
}
PATTERN = "(?U)" + "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without any of these characters or names hold no entity.
_QUICK = r"[0-9@]|(?:" + "|".join(n for names in GIVEN for n in names) + ") "
#: Classes of characters (first, last, step): digits, and letters of one script and case.
_RANGES = (
    (48, 57, 1), (65, 90, 1), (97, 122, 1), (0x0410, 0x042F, 1), (0x0430, 0x044F, 1),
    (0xC0, 0xD6, 1), (0xD8, 0xDE, 1), (0xDF, 0xF6, 1), (0xF8, 0xFF, 1), (0x0400, 0x040F, 1), (0x0450, 0x045F, 1),
    (0x0100, 0x0136, 2), (0x0101, 0x0137, 2), (0x0139, 0x0147, 2), (0x013A, 0x0148, 2), (0x014A, 0x0176, 2), (0x014B, 0x0177, 2), (0x0179, 0x017D, 2), (0x017A, 0x017E, 2),
    (0x0388, 0x038A, 1), (0x0391, 0x03A1, 1), (0x03A3, 0x03AB, 1), (0x03AC, 0x03AF, 1), (0x03B1, 0x03CB, 1), (0x03CC, 0x03CE, 1),
    (0x0531, 0x0556, 1), (0x0561, 0x0586, 1), (0x05D0, 0x05EA, 1), (0x0621, 0x063A, 1), (0x0641, 0x064A, 1), (0x0660, 0x0669, 1), (0x0905, 0x0939, 1), (0x0966, 0x096F, 1),
    (0x0E01, 0x0E2E, 1), (0x10D0, 0x10F0, 1), (0x3041, 0x3096, 1), (0x30A1, 0x30FA, 1), (0x4E00, 0x9FFF, 1), (0xAC00, 0xD7A3, 1), (0xFF10, 0xFF19, 1),
)
#: Endings of surnames that tell the gender. Fixed values.
_ENDING = r"(?<=.)(?:ская|цкая|ова|ева|ёва|ина|ына|ский|цкий|ов|ев|ёв|ин|ын)$"
#: What stays of an access key.
_MARK = r"^(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_])"
KEY, KEY_NAME = 4242, "spark.riftline.pii.key"
#: Replacements that differ from those of the key are broadcast in parts of at most this many.
PART = 50_000
#: After so many rounds names, mails and secrets grow by a letter, so that a number space that the corpus fills is left. Other kinds fail after MOST_ROUNDS.
SAME_LENGTH, MOST_ROUNDS = 4, 64


def _shift(key: int, so_far: Column) -> Column:
    return F.xxhash64(F.lit(key), so_far)


def _moved(value: Column, low: int, size: int | Column, by: Column) -> Column:
    """Another member of the class of size values from low on, never the same one."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.lit(low) + F.pmod(value - low + 1 + F.pmod(by, size - 1), size)


def _cipher(text: Column, key: int, hexadecimal: Column) -> Column:
    """Each character moved within its class by a hash chained over all before it, so in linear time. Where hexadecimal, Latin letters stay in a-f."""
    classes = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(step).alias("step")) for low, high, step in _RANGES])

    def moved(c: Column, by: Column) -> Column:
        code = F.ascii(c)
        other = F.transform(
            F.filter(classes, lambda r: code.between(r["low"], r["high"]) & (F.pmod(code - r["low"], r["step"]) == 0)),
            lambda r: F.decode(F.unhex(F.lpad(F.hex(r["low"] + r["step"] * F.pmod((code - r["low"]) / r["step"] + 1 + F.pmod(by, (r["high"] - r["low"]) / r["step"]), (r["high"] - r["low"]) / r["step"] + 1).cast("long")), 4, "0")), "UTF-16BE"),
        )
        letters = F.when(hexadecimal, 6).otherwise(26)
        return (
            F.when(code.between(48, 57), F.chr(_moved(code, 48, 10, by)))
            .when(code.between(97, F.lit(96) + letters), F.chr(_moved(code, 97, letters, by)))
            .when(code.between(65, F.lit(64) + letters), F.chr(_moved(code, 65, letters, by)))
            .when(code < 128, c).otherwise(F.coalesce(F.get(other, F.lit(0)), c))
        )

    def step(acc: Column, c: Column) -> Column:
        return F.struct(F.concat(acc["out"], moved(c, acc["by"])).alias("out"), F.xxhash64(acc["by"], c).alias("by"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.xxhash64(F.lit(key)).alias("by")), step)["out"]


def _address(text: Column, key: int) -> Column:
    octets = F.split(text, r"\.")
    each = F.transform(octets, lambda x, i: _moved(x.cast("long"), 0, 256, _shift(key, F.array_join(F.slice(octets, 1, i), "."))).cast("string"))
    return F.array_join(each, ".")


def _given(name: Column, key: int) -> Column:
    """Another given name of the same gender and script."""
    new = name
    for names in GIVEN:
        listed = F.array(*[F.lit(n) for n in names])
        place = F.array_position(listed, name)
        new = F.when(place > 0, F.element_at(listed, (_moved(place - 1, 0, len(names), _shift(key, F.lit("given"))) + 1).cast("int"))).otherwise(new)
    return new


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(list(KINDS.items())):
        out = F.when(entity.rlike(f"(?U)^(?:{pattern})$"), name).otherwise(out)
    return out


def surrogate(entity: Column, key: int) -> Column:
    """What stays at the beginning, the cipher of the middle, and what stays at the end."""

    def of(k: Column) -> Column:
        head = F.when(k == "name", F.regexp_extract(entity, r"^\S+ ", 0)).when(k == "phone", F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0))
        head = head.when(k == "iban", F.substr(entity, F.lit(1), F.lit(2))).when(k == "key", F.regexp_extract(entity, _MARK, 0)).otherwise("")
        tail = F.when(k == "email", F.regexp_extract(entity, r"\.[^.]*$", 0)).when(k == "name", F.regexp_extract(entity, _ENDING, 0)).otherwise("")
        return _let(F.struct(k.alias("k"), head.alias("head"), tail.alias("tail")), cut)

    def cut(p: Column) -> Column:
        middle = F.substr(entity, F.length(p["head"]) + 1, F.length(entity) - F.length(p["head"]) - F.length(p["tail"]))
        head = F.when(p["k"] == "name", F.concat(_given(F.rtrim(p["head"]), key), F.lit(" "))).otherwise(p["head"])
        return F.when(p["k"] == "ip", _address(entity, key)).otherwise(F.concat(head, _cipher(middle, key, p["k"].isin("secret", "ipv6")), p["tail"]))

    return _let(kind(entity), of)


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _found(text: Column) -> Column:
    return F.when(text.rlike(_QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _grown(entity: Column, letters: int) -> Column:
    k, more = kind(entity), F.lit("a" * letters)
    return F.when(k == "email", F.concat(more, entity)).when(k.isin("name", "secret"), F.concat(entity, more)).otherwise(entity)


def resolved(docs: DataFrame, key: int = KEY) -> DataFrame:
    """(entity, surrogate) of the entities whose surrogate under key equals an entity of the corpus or another's surrogate. Theirs equals none.

    Each round enciphers the entities that are left by the next key, and keeps those that meet neither an entity nor any surrogate made so far.
    """
    left = written(docs.select(F.explode(_found(F.col("text"))).alias("entity")).distinct(), "entities")
    used, done = left.select(F.col("entity").alias("surrogate")), left.limit(0).select("entity", F.col("entity").alias("surrogate"))
    for k in itertools.count():
        made = left.select("entity", surrogate(_grown(F.col("entity"), k // SAME_LENGTH) if k >= SAME_LENGTH else F.col("entity"), key + k).alias("surrogate"))
        made = written(made, "surrogates")
        every = made.unionByName(used.withColumn("entity", F.lit(None).cast("string")))
        groups = every.groupBy("surrogate").agg(F.max(F.col("entity").isNull()).alias("met"), F.sort_array(F.collect_list("entity")).alias("es"))
        left = written(groups.select(F.explode(F.expr("filter(es, (e, i) -> met OR i > 0)")).alias("entity")), "left")
        if k:
            done = done.unionByName(made.join(left, "entity", "left_anti"))
        if left.isEmpty():
            return done
        if k == MOST_ROUNDS:
            raise ValueError(f"{left.count()} entities have no surrogate that is not an entity of the corpus or another's surrogate")
        used = used.unionByName(made.select("surrogate"))


def replace(docs: DataFrame, key: int, others: DataFrame | None = None) -> DataFrame:
    """All columns of docs, with text rewritten, plus n_entities.

    others has the (entity, surrogate) that differ from what key gives: tables of at most PART rows each, broadcast one after the other, with the
    replacements written in between. A null text stays null with no entity. Texts are searched whole. Repeated rows are rewritten alike. A column
    n_entities is replaced.
    """
    text, found = F.col("text"), F.col("_f")
    out = docs.withColumn("_f", _found(text)).withColumn("_p", F.when(F.size("_f") > 0, F.split(text, PATTERN, -1)))
    if others is None:
        out = out.withColumn("_s", F.transform(found, lambda f: surrogate(f, key)))
    else:
        parts = -(-others.count() // PART)
        out = out.withColumn("_s", F.transform(found, lambda f: F.lit(None).cast("string")))
        for i in range(parts):
            some = others.where(F.pmod(F.xxhash64("entity"), F.lit(parts)) == i) if parts > 1 else others
            one = some.agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_others"))
            out = out.join(F.broadcast(one), how="left")  # one row: about PART entities
            out = out.withColumn("_s", F.transform(F.arrays_zip("_f", "_s"), lambda x: F.coalesce(x["_s"], F.try_element_at(F.col("_others"), x["_f"])))).drop("_others")
            if parts > 1:
                out = written(out, "replaced")
        out = out.withColumn("_s", F.transform(F.arrays_zip("_f", "_s"), lambda x: F.coalesce(x["_s"], surrogate(x["_f"], key))))
    pieces = F.transform(F.arrays_zip("_p", "_s"), lambda x: F.concat(x["_p"], F.coalesce(x["_s"], F.lit(""))))
    out = out.withColumn("text", F.when(F.size("_f") > 0, F.array_join(pieces, "")).otherwise(text)).withColumn("n_entities", F.size("_f").cast("long"))
    return out.drop("_f", "_p", "_s")


def surrogates(docs: DataFrame, key: int | None = None) -> DataFrame:
    """key: None for that of the session."""
    key = int(docs.sparkSession.conf.get(KEY_NAME, str(KEY))) if key is None else key
    others = written(resolved(docs.select("text"), key), "others")
    return replace(docs, key, None if others.isEmpty() else others)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates(docs).select("doc_id", "text", "n_entities")
