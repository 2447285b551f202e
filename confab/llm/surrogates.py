"""Personal data replaced by keyed surrogates of the same kind, built-in functions only.

Found are e-mail addresses, phone numbers, IP addresses, payment cards (with a right check digit), IBANs, social security and identity
numbers, long hexadecimal secrets, and names of people (after a title, or a known given name before a family name). An entity's surrogate
comes from a keyed SHA-256 of its kind and canonical form, so every mention in every document, however it is written, gets the same
one. Surrogates keep the kind (card numbers keep issuer digit and check sum, addresses stay addresses), the format (separators,
groups, letter case, number of digits), and for names the gender and script.

All distinct entities of the corpus form one table in which collisions are settled: where two entities draw one surrogate, or a
surrogate is itself an entity of the corpus, the later draws again with a higher round number, until every surrogate is its own. A
kind grows with its draws, so this ends for any number of entities: names take a syllable with every draw, and numbers a digit (network
addresses the longer version of the protocol) once ``ROOM`` draws have failed. Once a person is named in a document, single mentions
of the given or family name in it are replaced as well.

The key is secret: it is given by the caller or read from the session's ``spark.confab.pseudonym.key``, and there is no default.

Defined results: a null text stays null; a text without findings is unchanged; equal rows have equal results; a null id is treated as
any other; columns are unchanged but for ``text``, and ``n_found`` (mentions replaced) is added (replaced if present); an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from confab.llm.texts import fresh
from confab.session import cut

KEY = "spark.confab.pseudonym.key"
ROOM = 12  # draws in a kind's own format before it grows
BROADCAST_MENTIONS = 1 << 19  # mentions, of some fifty bytes each, that may go to every task
KINDS = {
    "email": r"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "dni": r"(?<![0-9A-Za-z])[0-9]{8}[A-Z](?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "κυρία"),
          "n": ("Dr", "Prof", "Professor")}
GIVEN = {"f": ("Anna", "Maria", "Sarah", "Laura", "Emma", "Julia", "Claire", "Sophie", "Carmen", "Lucía", "Ingrid", "Heike", "Анна", "Мария", "Ольга", "Елена", "Μαρία"),
         "m": ("John", "James", "Peter", "Michael", "Thomas", "David", "Pierre", "Jean", "Carlos", "José", "Hans", "Jürgen", "Иван", "Сергей", "Дмитрий", "Γιώργος")}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # check letter by the number modulo 23
# syllables and endings from which names are made, by script
SYLLABLES = {
    "latin": ("ba", "be", "bri", "ca", "ce", "da", "de", "el", "fa", "fe", "ga", "ha", "he", "jo", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "ra", "ri", "ro", "sa", "ta", "vi"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "да", "де", "жа", "за", "зе", "ка", "ке", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "ни", "па", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти"),
    "greek": ("βα", "βε", "γα", "δα", "δε", "ζα", "θα", "θε", "κα", "κε", "λα", "λε", "λι", "λο", "μα", "με", "μι", "να", "νε", "νι", "πα", "πε", "ρα", "ρε", "ρι", "ρο", "σα", "σε", "τα", "τε", "τι", "φα"),
}
ENDINGS = {
    "latin": {"f": ("na", "lia", "ra", "tta"), "m": ("nus", "rt", "lon", "der"), "n": ("n", "s", "ren", "vin"), "s": ("sson", "mann", "ley", "dez")},
    "cyrillic": {"f": ("на", "лия", "ра", "та"), "m": ("н", "рт", "лон", "дер"), "n": ("н", "с", "рен", "вин"), "s": ("нко", "дзе", "ник", "чук")},
    "greek": {"f": ("να", "λια", "ρα", "τη"), "m": ("νος", "ρης", "λος", "ντας"), "n": ("ν", "ς", "ρι", "βι"), "s": ("δης", "κης", "λου", "πουλος")},
}

# lookaheads let most positions of a text fail at their first character
_NAME = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
_WORD = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
_TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {_NAME}(?: {_NAME}){{0,2}}(?![\p{{L}}\p{{N}}])"
_GIVEN = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(n for g in GIVEN.values() for n in g)}) {_NAME}(?![\p{{L}}\p{{N}}])"
_FIRST = "".join(sorted({w[0] for group in (*TITLES.values(), *GIVEN.values()) for w in group}))
_PLAIN = "|".join(KINDS.values())
NAMES = f"(?=[{_FIRST}])(?:{_TITLED}|{_GIVEN})"
APPLY = f"{_PLAIN}|{_WORD}"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_rest(digits: Column) -> Column:
    """Check sum of a digit string modulo 10; 0 for a right card number."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(
        F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(parts, F.lit(0), lambda a, v: a + v) % 10


def iban_rest(text: Column) -> Column:
    """An IBAN's letters and digits as one number modulo 97 (letters are 10 to 35, the first four characters come last); 1 for a right one."""
    turned = F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def kind_of(mention: Column) -> Column:
    kind = F.lit("name")
    for k, pattern in reversed(KINDS.items()):
        kind = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(k)).otherwise(kind)
    digits = _digits(mention)
    bad = (kind == "card") & (~F.length(digits).between(13, 19) | (luhn_rest(digits) != 0))
    return F.when(~bad, kind)


def canonical(kind: Column, mention: Column) -> Column:
    return F.when(kind.isin("phone", "ssn", "card"), _digits(mention)).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(
        kind == "ip", mention).otherwise(F.lower(mention))


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def mentions(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, mention, kind, canon) of every different mention; names come as one row per name."""
    plain = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(_PLAIN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    both = F.concat(plain, F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)))
    found = rows.select("doc_id", "text_key", F.explode(F.array_distinct(both)).alias("m"))
    found = found.select("doc_id", "text_key", "m", kind_of(F.col("m")).alias("kind")).where(F.col("kind").isNotNull())
    plain = found.where("kind <> 'name'").select("doc_id", "text_key", F.col("m").alias("mention"), "kind", canonical(F.col("kind"), F.col("m")).alias("canon"))
    words = F.split("m", " ")
    head = F.regexp_replace(words[0], r"\.\z", "")
    titles, given = [t for g in TITLES.values() for t in g], {g: list(v) for g, v in GIVEN.items()}
    titled = head.isin(titles)
    names = F.when(titled, F.slice(words, 2, F.size(words) - 1)).otherwise(words)
    by_name = lambda w: F.when(w.isin(given["f"]), "f").when(w.isin(given["m"]), "m").otherwise("n")
    gender = F.when(head.isin(list(TITLES["f"])), "f").when(head.isin(list(TITLES["m"])), "m").otherwise(by_name(names[0]))
    part = found.where("kind = 'name'").select("doc_id", "text_key", F.posexplode(names).alias("i", "mention"), F.size(names).alias("n"), gender.alias("gender"))
    role = F.when(F.col("i") == F.col("n") - 1, "s").otherwise(F.col("gender"))
    named = part.select("doc_id", "text_key", "mention", F.concat(F.lit("name "), role, F.lit(" "), script_of(F.col("mention"))).alias("kind"), F.lower("mention").alias("canon"))
    # a word that is a given name here and a family name there is one entity
    return plain.union(named)


def _digest(key: str, kind: Column, canon: Column, draw: Column, part: str) -> Column:
    """HMAC-SHA-256 of an entity and its draw, as hex digits."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\x1f", kind, canon, draw.cast("string"), F.lit(part)).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _number(digest: Column, i: int) -> Column:
    """Seven hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long")


def _pick(options: tuple, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def _like(pattern: Column, digest: Column) -> Column:
    """``pattern`` with its letters and digits drawn anew from a digest; other characters stay."""
    code = lambda i: F.conv(F.substring(digest, ((i * 2) % 63 + 1).cast("int"), 2), 16, 10).cast("int") + i
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.transform(F.split(pattern, ""), lambda c, i: F.when(c.rlike("[0-9]"), (code(i) % 10).cast("string")).when(
        c.rlike("[a-z]"), F.substring(letters, code(i) % 26 + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.upper(F.substring(letters, code(i) % 26 + 1, F.lit(1)))).otherwise(c)), "")


def surrogate(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """Surrogate of a canonical form; draw 0 is the first."""
    d = _digest(key, kind, canon, draw, "a")
    drawn = _like(canon, d)
    surplus = F.substring(F.conv(F.substring(d, 40, 14), 16, 10), F.lit(1), F.floor(draw / ROOM).cast("int"))  # a digit more for every ROOM draws
    body = F.concat(F.substring(canon, 1, 1), F.substring(drawn, F.lit(2), F.length(canon) - 2))
    body = F.concat(body, surplus)
    card = F.concat(body, ((10 - luhn_rest(F.concat(body, F.lit("0")))) % 10).cast("string"))
    fixed = F.greatest(F.length(canon) - 9, F.lit(0))  # leading digits (country, area) that stay
    phone = F.concat(F.substring(canon, F.lit(1), fixed), F.substring(drawn, fixed + 1, F.lit(9)), surplus)
    octets = F.concat_ws(".", *[(_number(d, i) % 254 + 1).cast("string") for i in range(4)])
    address = F.when(draw < ROOM, octets).otherwise(F.concat_ws(":", F.lit("2001:db8"), *[F.substring(d, 1 + 4 * i, 4) for i in range(6)]))
    at = F.locate("@", canon)
    mail = F.concat(F.substring(drawn, F.lit(1), at), F.lit("m"), F.substring(d, 50, 4), F.lit(".example."), F.substring_index(canon, ".", -1))
    account = F.concat(F.substring(drawn, F.lit(5), F.length(canon)), surplus)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((98 - iban_rest(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
    number = F.concat(F.substring(drawn, 1, 8), surplus)
    dni = F.concat(number, F.substring(F.lit(DNI_LETTERS), (number.cast("long") % 23 + 1).cast("int"), F.lit(1)))
    secret = F.substring(F.concat(d, _digest(key, kind, canon, draw, "b")), F.lit(1), F.length(canon))
    name = F.lit(None).cast("string")
    for script in SYLLABLES:
        for role, endings in ENDINGS[script].items():
            middle = F.array_join(F.transform(F.sequence(F.lit(0), draw.cast("int") + 1), lambda i: _pick(SYLLABLES[script], F.conv(F.substring(d, (i * 3 % 60 + 1).cast("int"), 3), 16, 10).cast("long"))), "")
            name = F.when(kind == f"name {role} {script}", F.concat(middle, _pick(endings, _number(d, 8)))).otherwise(name)
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", address).when(kind == "email", mail).when(
        kind == "iban", iban).when(kind == "secret", secret).when(kind == "ssn", F.concat(drawn, surplus)).when(kind == "dni", dni).otherwise(name)


def _group(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other."""
    return F.when(kind.startswith("name"), "name").otherwise(kind)


def entity_table(found: DataFrame, key: str) -> DataFrame:
    """(grp, canon, surrogate) of every distinct entity, one surrogate each and none of them an entity itself."""
    grp = _group(F.col("kind")).alias("grp")
    # the smallest kind names a word that occurs in several roles: f before m, n and s
    table = cut(found.groupBy(grp, "canon").agg(F.min("kind").alias("kind")).withColumn("draw", F.lit(0)).withColumn(
        "surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))), "entities")
    while True:
        nth = F.row_number().over(Window.partitionBy("grp", "surrogate").orderBy("draw", "canon"))
        real = table.select(F.col("grp").alias("g"), F.col("canon").alias("c"))
        marked = table.withColumn("nth", nth).join(real, (F.col("grp") == F.col("g")) & (F.col("surrogate") == F.col("c")), "left")
        marked = cut(marked.select("grp", "canon", "kind", "draw", "surrogate", ((F.col("nth") > 1) | F.col("c").isNotNull()).alias("clash")), "entity_round")
        if not marked.where("clash").limit(1).count():
            return marked.select("grp", "canon", "surrogate")
        again = F.col("draw") + F.when(F.col("clash"), 1).otherwise(0)
        table = marked.select("grp", "canon", "kind", again.alias("draw"), "surrogate", "clash").withColumn(
            "surrogate", F.when(F.col("clash"), surrogate(key, F.col("kind"), F.col("canon"), F.col("draw"))).otherwise(F.col("surrogate"))).drop("clash")

def dressed(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the format of a mention."""
    before = lambda i: F.length(_digits(F.substring(mention, F.lit(1), i)))
    grouped = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(made, before(i) + 1, F.lit(1))).otherwise(c)), "")
    spaced = lambda i: F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))
    iban = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, spaced(i) + 1, F.lit(1)))), "")
    cased = F.when(mention == F.upper(mention), F.upper(made)).when(mention.rlike(r"\A\p{Lu}"), F.initcap(made)).otherwise(made)
    rest = lambda used: F.substring(made, used + 1, F.length(made))  # noqa: E731  (what a grown surrogate has more)
    grouped = F.concat(grouped, rest(F.length(_digits(mention))))
    iban = F.concat(iban, rest(F.length(F.replace(mention, F.lit(" "), F.lit("")))))
    return F.when(kind.isin("phone", "ssn", "card"), grouped).when(kind == "iban", iban).when(kind.startswith("name"), cased).when(
        (kind == "email") & (mention == F.upper(mention)), F.upper(made)).when(kind == "dni", F.upper(made)).otherwise(made)


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text_key, swaps): a map from mention to surrogate for every document that has any."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).where(F.col("text").isNotNull())
    found = cut(mentions(rows).distinct(), "mentions")
    table = entity_table(found, key)
    joined = found.withColumn("grp", _group(F.col("kind"))).join(table, ["grp", "canon"])
    # names are also known in capitals, and as written in running text
    forms = F.when(F.col("kind").startswith("name"), F.array_distinct(F.array("mention", F.upper("mention"), F.initcap("mention")))).otherwise(F.array("mention"))
    each = joined.select("doc_id", "text_key", "kind", "surrogate", F.explode(forms).alias("mention"))
    pair = F.struct("mention", dressed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("made"))
    whole = each.groupBy("doc_id", "text_key", "mention").agg(F.min(pair).alias("pair"))
    return whole.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list("pair")).alias("swaps"))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of replaced mentions in ``n_found``; ``key`` comes from the session if not given."""
    key = key or docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"surrogates need a secret key: give one, or set {KEY}")
    keep = [c for c in docs.columns if c.lower() != "n_found"]
    tk, own, own_key, swaps, ents = (fresh(docs.columns, c) for c in ("text_key", "of_doc", "of_key", "swaps", "found_parts"))
    maps = cut(replacements(docs, key), "swaps")
    few = (maps.agg(F.sum(F.size("swaps"))).first()[0] or 0) <= BROADCAST_MENTIONS
    maps = maps.toDF(own, own_key, swaps)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(tk, F.xxhash64("text"))
    both = rows.join(F.broadcast(maps) if few else maps, rows["doc_id"].eqNullSafe(maps[own]) & (rows[tk] == maps[own_key]), "left")
    parts = both.select(*[F.col(f"`{c}`") for c in keep], swaps, F.when(F.col(swaps).isNotNull(), F.regexp_extract_all("text", F.lit(APPLY), F.lit(0))).alias(ents))
    new = F.transform(ents, lambda e: F.coalesce(F.element_at(F.col(swaps), e), e))
    gaps = F.split("text", APPLY)
    text = F.when(F.col(swaps).isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, e: F.concat(g, e)), ""))
    count = F.coalesce(F.size(F.filter(ents, lambda e: F.element_at(F.col(swaps), e).isNotNull())), F.lit(0))
    return parts.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in keep], F.when(F.col(swaps).isNull(), 0).otherwise(count).cast("long").alias("n_found"))


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with surrogates, and n_found of every document."""
    return pseudonymise(docs.select("doc_id", "text"), key)



