"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, phone numbers, payment cards,
secrets and titled personal names. Each distinct entity gets one surrogate for the
whole corpus, drawn from HMAC-SHA-256, under a secret key, of its type, its canonical form and an attempt
number, in the same format: digits for digits in the same grouping (cards keep a valid
check digit, phone numbers their country code), hexadecimal for hexadecimal in the same case, octets for octets, a name
in the same script and of the same gender for a name. A name under titles of both genders is two entities.

Surrogates are checked: one that another entity also drew, or that is itself an entity of
the corpus, is drawn again by all but the least of those entities, until all are distinct (distinctness);
equal entities share their surrogate wherever they occur (coreference). Every draw keeps the format. Names have as
many forms as are needed: each draw has a syllable more than the one before, so any number of names is distinct after a few draws.
Numbers keep their length; from draw ``WIDER`` on, the digits that are otherwise left alone (exchange, first digit after the
country code) are drawn too, so a format is full only when its entities are most of all numbers of that length. Where
``ATTEMPTS`` draws did not find a free form even so, a surrogate may equal an entity of the corpus, but no other surrogate; where
``LAST`` draws find none either, the run fails rather than give two entities one surrogate.

The key is the caller's and has no default: who knows it can recompute the surrogate of a guessed entity. It is part of the query
plan, so plans and event logs of a run are as secret as the key. Only the registered query, whose input is public, falls back on a published key.

Numbers that are not valid cards, and dotted numbers that are not addresses, stay as
they are. Defined results: null text stays null; text without an entity stays byte for
byte the same, an empty or very long one too; rows that repeat are rewritten alike; other columns pass through,
whatever their names (where n_entities is one of them, the added column gets an underscore more); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm.common import durable, free_names, table

# Fixed lists, chosen here.
FEMALE = ["Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara"]
MALE = ["Adam", "Boris", "Carl", "David", "Edward", "Frank", "George", "Henry", "Ivan", "James", "Leo", "Martin", "Oscar", "Paul", "Robert", "Victor"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"]
MALE_CYRILLIC = ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"]
FEMALE_GREEK = ["Άννα", "Ελένη", "Ειρήνη", "Ζωή", "Μαρία", "Νίκη", "Σοφία", "Χαρά"]
MALE_GREEK = ["Γιώργος", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"]
FEMALE_ARMENIAN = ["Աննա", "Անի", "Արփի", "Գայանե", "Լուսինե", "Մարիամ", "Նարե", "Սոնա"]
MALE_ARMENIAN = ["Արամ", "Արթուր", "Գարիկ", "Դավիթ", "Հայկ", "Նարեկ", "Սարգիս", "Տիգրան"]
LATIN_PARTS = ["ba", "ve", "do", "ka", "le", "mi", "no", "ro", "sa", "tu", "wen", "fi"]
CYRILLIC_PARTS = ["ба", "ве", "до", "ка", "ле", "ми", "но", "ро", "са", "ту"]
GREEK_PARTS = ["βα", "γε", "δο", "κα", "λε", "μι", "νο", "ρο", "σα", "τυ"]
ARMENIAN_PARTS = ["բա", "գե", "դո", "կա", "լե", "մի", "նո", "րո", "սա", "տու"]
#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "[17]", "20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Señora", "Госпожа"]
MALE_TITLES = ["Mr", "Monsieur", "Herr", "Señor", "Господин"]

_TITLE = "|".join(FEMALE_TITLES + MALE_TITLES)
#: A domain name has 127 labels at most; without that bound the expression would go one call deeper for each label of a hostile text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z-])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9A-Za-z-])|(?<![0-9A-Za-z-])[0-9]{13,19}(?![0-9A-Za-z-])"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IP, PHONE, CARD, SECRET, NAME))
#: What any entity has in it; quicker to look for.
HINT = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|[0-9a-fA-F]{{32}}|(?:{_TITLE})[. ]"
#: Draws after which numbers keep less of the original.
WIDER = 8
#: Draws after which a form that is itself an entity of the corpus will do, and after which the run fails.
ATTEMPTS, LAST = 24, 400
#: The setting that holds the key of the registered query and the pipeline, and the published key they use on public data where it is not set.
KEY_SETTING, PUBLISHED_KEY = "spark.inkgraph.pii.key", "inkgraph"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right (the last not) doubled."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))


def kind_of(value: Column) -> Column:
    """email, ip, phone, card, secret, name; or null for what only looks like one."""
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^(?:{_TITLE})[. ]"), "name")
        .when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.when(F.forall(octets, lambda x: x.cast("int") <= 255), "ip"))
        .when(value.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(value.rlike("^[0-9a-fA-F]{32,}$") & value.rlike("[a-fA-F]"), "secret")
        .when(F.length(digits_of(value)).between(13, 19), F.when((luhn_sum(digits_of(value)) % 10 == 0) & ~digits_of(value).rlike("^0+$"), "card"))
    )


def canonical(value: Column, kind: Column) -> Column:
    """What makes two mentions one entity: letter case of addresses does not, nor do separators in numbers."""
    return F.when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits_of(value))).when(kind == "card", digits_of(value)).when(kind == "secret", F.lower(value)).when(kind == "name", F.regexp_replace(F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", ""), "’", "'")).otherwise(value)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLISHED_KEY)


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in 64 lower-case hexadecimal digits."""
    if not key:
        raise ValueError("surrogates need a key")
    secret = key.encode()
    block = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _number(hex_text: Column, at: int, width: int = 8) -> Column:
    return F.conv(F.substring(hex_text, at, width), 16, 10).cast("bigint")


def _digit_stream(draw: Column) -> Column:
    """24 decimal digits of a draw."""
    return F.concat(*[F.lpad((_number(draw, 1 + 12 * i, 12) % 1_000_000).cast("string"), 6, "0") for i in range(4)])


def country_code(core: Column) -> Column:
    """Length of '+' and the country code of a canonical phone number; 0 without one."""
    return F.when(~core.startswith("+"), 0).when(core.rlike(rf"^\+{ONE_DIGIT}"), 2).when(core.rlike(rf"^\+(?:{TWO_DIGITS})"), 3).otherwise(4)


def surrogate_core(kind: Column, core: Column, gender: Column, attempt: int) -> Column:
    """The canonical form of the surrogate: same kind, same length where the format fixes one. Reads the columns that `_draw` adds."""
    draw = F.col("core_draw")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (_number(draw, at) % len(names) + 1).cast("int"))
    octet = lambda i, low, width: (_number(draw, 1 + 8 * i) % width + low).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)) if attempt < WIDER else F.concat_ws(".", *[octet(i, 0, 256) for i in range(4)])
    body = F.concat(F.substring(core, 1, 1), F.expr("substring(core_stream, 1, length(core_in) - 2)"))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    # Ten digits at home: area, the exchange as it is, line. Elsewhere the country code and the first digit stay.
    ten = F.expr("concat(substring(core_in, 1, core_code), cast(2 + cast(substring(core_stream, 1, 1) as int) % 8 as string), substring(core_stream, 2, 2), substring(core_in, core_code + 4, 3), substring(core_stream, 4, 4))")
    other = F.expr("concat(substring(core_in, 1, core_code + 1), substring(core_stream, 1, length(core_in) - core_code - 1))")
    if attempt >= WIDER:
        ten = other = F.expr("concat(substring(core_in, 1, core_code), substring(core_stream, 1, length(core_in) - core_code))")
    phone = F.when((F.length(core) - F.col("core_code") == 10) & (F.col("core_code").isin(0) | core.startswith("+1")), ten).otherwise(other)
    domain = F.substring_index(core, "@", -1)
    email = F.concat(F.lower(pick(FEMALE + MALE, 1)), F.lit("."), F.substring(draw, 9, 8), F.lit("@"), F.lit("mail"), (_number(draw, 17) % 10).cast("string"), F.lit(".example."), F.substring_index(domain, ".", -1))
    n_parts = 4 + min(attempt, 11)  # as many as the draw has digits for
    chosen = lambda parts, at: F.element_at(F.array(*[F.lit(x) for x in parts]), (_number(F.col("core_long"), at) % len(parts) + 1).cast("int"))
    syllables = lambda parts: F.initcap(F.concat(*[chosen(parts, 9 + 8 * i) for i in range(n_parts)]))
    first, last = F.when(gender == "f", pick(FEMALE, 1)).otherwise(pick(MALE, 1)), syllables(LATIN_PARTS)
    for script, female, male, parts in (("Cyrillic", FEMALE_CYRILLIC, MALE_CYRILLIC, CYRILLIC_PARTS), ("Greek", FEMALE_GREEK, MALE_GREEK, GREEK_PARTS), ("Armenian", FEMALE_ARMENIAN, MALE_ARMENIAN, ARMENIAN_PARTS)):
        own = core.rlike(rf"\p{{Is{script}}}")
        first, last = F.when(own, F.when(gender == "f", pick(female, 1)).otherwise(pick(male, 1))).otherwise(first), F.when(own, syllables(parts)).otherwise(last)
    name = F.when(core.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)
    made = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.concat(body, check.cast("string"))).when(kind == "phone", phone).when(kind == "secret", F.expr("substring(core_long, 1, length(core_in))")).when(kind == "name", name)
    return made


def _draw(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add column drawn. Secrets longer than 128 digits repeat their draw."""
    draw = F.col("core_draw")
    long_draw = F.concat(draw, F.sha2(F.concat(draw, F.lit("+")), 256))
    own = entities.withColumn("core_draw", keyed(key, F.concat_ws("\x1f", "kind", "core", "gender", F.lit(str(attempt)))))
    own = own.withColumns({"core_in": F.col("core"), "core_code": country_code(F.col("core")), "core_stream": _digit_stream(draw), "core_long": F.repeat(long_draw, F.floor(F.length("core") / 128).cast("int") + 1)})
    return own.withColumn("drawn", surrogate_core(F.col("kind"), F.col("core"), F.col("gender"), attempt)).select(*entities.columns, "drawn")


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, gender) -> drawn, all drawn forms distinct within a kind and none an entity of the corpus.

    Entities that clash draw again. Each round keeps the least of those that
    drew the same form, so the number left falls fast; rounds end when none is left.
    """
    known = entities.select("kind", F.col("core").alias("drawn")).distinct()
    left, kept, attempt = entities, None, 0
    while True:
        drawn = _draw(left, key, attempt)
        free = drawn.join(known, ["kind", "drawn"], "left_anti") if attempt < ATTEMPTS else drawn.filter("drawn <> core")
        if kept is not None:
            free = free.join(kept.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        good = durable(free.groupBy("kind", "drawn").agg(F.min(F.struct("core", "gender")).alias("who")).select("kind", F.col("who.core").alias("core"), F.col("who.gender").alias("gender"), "drawn"))
        kept = good if kept is None else kept.unionByName(good)
        left = durable(left.join(good.select("kind", "core", "gender"), ["kind", "core", "gender"], "left_anti"))
        if left.isEmpty():
            return kept
        attempt += 1
        if attempt >= LAST:
            raise ValueError("a format has too few forms for its entities")


def reshape(kind: Column, original: Column, drawn: Column) -> Column:
    """The drawn form in the dress of the mention: separators, letter case and title as they were."""
    digits = digits_of(drawn)
    shape = F.split(original, "")
    seen = F.aggregate(shape, F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), lambda acc, c: F.struct((acc["i"] + c.rlike("^[0-9]$").cast("int")).alias("i"), F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out")), lambda acc: F.concat(acc["out"], F.substring(digits, acc["i"] + 1, F.lit(99))))
    title = F.regexp_extract(original, rf"^(?:{_TITLE})\.? ", 0)
    return F.when(kind.isin("phone", "card"), seen).when(kind.isin("email", "secret") & (original == F.upper(original)), F.upper(drawn)).when(kind == "name", F.concat(title, drawn)).otherwise(drawn)


def pseudonymise(docs: DataFrame, key: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities of ``text`` replaced; column n_entities is added.

    Documents without an entity are not shuffled. Of the others, entities go out
    (not texts), are made distinct before they are drawn, and come back as one array for
    each (doc, text); the text is split at the same pattern and zipped with it.
    """
    names = docs.columns
    found, held, new, number = free_names(names, "pii_found", "pii_doc", "pii_new", "n_entities")
    body = F.col(text)
    every = docs.withColumn(held, F.concat_ws(":", F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.md5(body)))
    clean = docs.filter(body.isNull() | ~body.rlike(HINT) | ~body.rlike(PATTERN)).withColumn(number, F.lit(0))
    rich = every.filter(body.rlike(HINT) & body.rlike(PATTERN)).withColumn(found, F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    mentions = rich.select(F.col(held).alias("pii_doc"), F.posexplode(found).alias("at", "value"))
    gender = F.when(F.col("kind") == "name", F.when(F.col("value").rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})[. ]"), "f").otherwise("m")).otherwise("")
    typed = mentions.withColumn("kind", kind_of(F.col("value"))).withColumn("core", canonical(F.col("value"), F.col("kind"))).withColumn("gender", gender)
    real = durable(typed.filter("kind is not null").select("pii_doc", "at", "value", "kind", "core", "gender").distinct())
    entities = real.select("kind", "core", "gender").distinct()
    drawn = mapping(durable(entities), key)
    replaced = real.join(drawn, ["kind", "core", "gender"]).select("pii_doc", "at", reshape(F.col("kind"), F.col("value"), F.col("drawn")).alias("new"))
    by_doc = replaced.groupBy(F.col("pii_doc").alias(held)).agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias(new))
    pieces = F.split(body, PATTERN, -1)
    rebuilt = F.concat_ws("", F.zip_with(pieces, F.transform(F.col(found), lambda v, i: F.coalesce(F.element_at(F.col(new), i), v)), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))))
    joined = rich.join(by_doc, held, "left")
    count = F.when(F.col(new).isNull(), 0).otherwise(F.size(F.map_keys(F.col(new))))
    changed = joined.select(*[F.when(F.col(new).isNull(), body).otherwise(rebuilt).alias(text) if c == text else F.col(f"`{c}`") for c in names], count.alias(number))
    return clean.unionByName(changed)


def op10_surrogates(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).select("doc_id", "n_entities", "text")
