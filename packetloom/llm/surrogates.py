"""Surrogates for personal data: e-mail addresses, telephone numbers, IPv4 addresses, payment cards, IBANs, social security
numbers, and names after a form of address.

Every distinct entity gets a replacement drawn from a keyed digest of its canonical form: the same entity, however it is
written, gets the same replacement in the way it is written there; digits become digits and letters letters, check digits
are valid again, names keep gender and script. Collision checks repeat the draw until no two entities of a kind share a
replacement and none is itself an entity of the texts. From the attempt WIDER on, kinds with few values of one shape draw
from more: addresses from all lengths of their parts, local parts and names grow. Detection, drawing and replacing are
DataFrame functions.

Persons keep their coreference. A name is replaced by its parts, the family name and the given name, each with a
replacement of its own that no other part of its gender shares: so Mr John Smith, Mr Smith and Dr Smith get one family name,
and Mrs Smith another. A form of address of either gender takes the gender that the document gives the same person, or to
a family name alone that of all its bearers. In a document with an addressed person, the bare full name and the bare family name are replaced too (as written, capitalised, or in capitals). A person who
is never addressed, and a given name alone, are not found; a family name that is also a word is replaced where that word is
capitalised, in such a document; a bare family name with bearers of both genders goes to the first replacement by spelling.

A null text stays null, an empty one empty; very long texts are read whole. Rows that repeat are replaced alike. A null id is allowed. All columns are
kept whatever their names; only the text changes. An empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.session import materialise

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}\p{Ll}[\p{L}'’-]*)?"
#: Forms of address by gender (f, m, and n for either).
ADDRESS = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа", "m": "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н",
           "n": "Dr|Prof"}
#: Kind and pattern, in the order in which they win at one place. No pattern starts inside a longer run of its kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w)",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(ADDRESS.values())})\.? {_NAME}",
}
#: One alternative a kind; the card's own group is the only numbered one of the whole.
ENTITY = "|".join(PATTERNS.values())
GIVEN = {
    "latin": {"f": "Anna Clara Elena Laura Maria Nora Paula Sofia".split(), "m": "Adam David Felix Jonas Lucas Martin Oscar Simon".split()},
    "cyrillic": {"f": "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(), "m": "Антон Борис Иван Лев Максим Олег Павел Роман".split()},
    "greek": {"f": "Άννα Ελένη Ειρήνη Μαρία".split(), "m": "Ανδρέας Γιώργος Νίκος Πέτρος".split()},
}
SYLLABLES = {"latin": "ba den fa gor hal ke lin mo nar pel rin sa tor ul ver wen".split(),
             "cyrillic": "ба ве го дар ел жу зор ил ка лен ми нор пет ра со тур".split(),
             "greek": "βα γο δε ζα θε κα λι μο νε πα ρι σο τα φι χα ψε".split()}
#: How given names end that are built of syllables, and endings of family names that a replacement keeps.
ENDINGS = {"latin": {"f": "a ina ella ia".split(), "m": "us in o ard".split()},
           "cyrillic": {"f": "а ина ия".split(), "m": "ий ан ей".split()}, "greek": {"f": "α η".split(), "m": "ος ης".split()}}
KEPT_ENDING = "(?:ова|ева|ина|ская|ский|ов|ев|ин|ου|ος|ης)$"
TITLED = rf"^(?:{'|'.join(ADDRESS.values())})\.? "
#: Draws in an entity's own shape before its replacement may be of another length.
WIDER = 4


def kind_of(entity: Column) -> Column:
    whole = [(k, F.regexp_like(entity, F.lit(f"^(?:{p})$"))) for k, p in PATTERNS.items()]
    return reduce(lambda rest, kp: F.when(kp[1], F.lit(kp[0])).otherwise(rest), reversed(whole), F.lit("name"))


def canonical_of(kind: Column, entity: Column) -> Column:
    """What the ways to write one entity have in common; names have parts instead (`persons`)."""
    return F.when(kind == "email", F.lower(entity)).when(kind == "ip", entity).otherwise(
        F.regexp_replace(entity, "[^0-9A-Za-z]", ""))


def _stream(key: str, *parts: Column) -> Column:
    """256 bytes as hexadecimal digits, from a keyed digest."""
    seed = F.concat_ws("\u0001", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{k}")), 512) for k in range(4)])


def _byte(stream: Column, k: Column) -> Column:
    """Sixteen bits at place k."""
    return F.conv(F.substr(stream, (k % 127) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _map_chars(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _substitute(text: Column, stream: Column) -> Column:
    """Digits by digits (no leading zero where there was none), lower and upper letters by such; all else stays."""
    def change(c, k):
        n = _byte(stream, k)
        return (F.when((k == 0) & F.regexp_like(c, F.lit("[1-9]")), (n % 9 + 1).cast("string"))
                .when(F.regexp_like(c, F.lit("[0-9]")), (n % 10).cast("string"))
                .when(F.regexp_like(c, F.lit("[a-z]")), F.char(97 + n % 26)).when(F.regexp_like(c, F.lit("[A-Z]")), F.char(65 + n % 26))
                .otherwise(c))
    return _map_chars(text, change)


def _luhn(body: Column) -> Column:
    """The digits with their check digit."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(country: Column, body: Column) -> Column:
    value = F.split(F.concat(body, country, F.lit("00")), "")
    rest = F.aggregate(value, F.lit(0), lambda a, c: F.when(
        F.regexp_like(c, F.lit("[A-Z]")), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + c.cast("int")) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _of_script(text: Column, make) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"\p{IsCyrillic}")), make("cyrillic")).when(
        F.regexp_like(text, F.lit(r"\p{IsGreek}")), make("greek")).otherwise(make("latin"))


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), n % len(words) + 1)


def _stem(script: str, stream: Column, least: int, attempt: Column) -> Column:
    """Syllables, one more every WIDER attempts."""
    return F.array_join(F.transform(F.sequence(F.lit(2), F.lit(1 + least) + (attempt / WIDER).cast("int")),
                                    lambda k: _pick(SYLLABLES[script], _byte(stream, k))), "")


def _family(canonical: Column, stream: Column, attempt: Column) -> Column:
    return F.concat(_of_script(canonical, lambda script: _stem(script, stream, 3, attempt)), F.regexp_extract(canonical, KEPT_ENDING, 0))


def _given(canonical: Column, stream: Column, attempt: Column) -> Column:
    """For `gender:name`: a usual name of the gender and script, and after a clash one of syllables with the gender's ending."""
    gender = F.substr(canonical, F.lit(1), F.lit(1))
    female = (gender == "f") | ((gender == "n") & (_byte(stream, F.lit(1)) % 2 == 0))

    def of(script):
        def by_gender(lists):
            return F.when(female, _pick(lists["f"], _byte(stream, F.lit(0)))).otherwise(_pick(lists["m"], _byte(stream, F.lit(0))))
        return F.when(attempt == 0, F.lower(by_gender(GIVEN[script]))).otherwise(F.concat(_stem(script, stream, 2, attempt), by_gender(ENDINGS[script])))

    return _of_script(canonical, of)


def draw(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical form at the given attempt."""
    stream = _stream(key, kind, canonical, attempt.cast("string"))
    changed = _substitute(canonical, stream)
    local, domain = F.split_part(canonical, F.lit("@"), F.lit(1)), F.split_part(canonical, F.lit("@"), F.lit(2))
    ending = F.regexp_extract(domain, r"\.[a-z]+$", 0)
    host = _substitute(F.regexp_replace(domain, r"\.[a-z]+$", ""), _stream(key, F.lit("domain"), domain))
    # A letter more every WIDER attempts, within the 64 characters of a local part.
    more = F.substr(_substitute(F.lit("a" * 63), _stream(key, F.lit("longer"), canonical, attempt.cast("string"))), F.lit(1), (attempt / WIDER).cast("int"))
    name = _substitute(local, stream)
    name = F.when(attempt < WIDER, name).otherwise(F.concat(F.substr(name, F.lit(1), 64 - F.length(more)), more))
    email = F.concat(name, F.lit("@"), host, ending)

    def octet(o, k):
        n = _byte(stream, k)
        return F.when(attempt >= WIDER, 1 + n % 254).when(F.length(o) == 3, 100 + n % 155).when(F.length(o) == 2, 10 + n % 90).otherwise(1 + n % 9).cast("string")

    ip = F.array_join(F.transform(F.split(canonical, r"\."), octet), ".")
    size = F.length(canonical)
    card = F.when(_luhn(F.substr(canonical, F.lit(1), size - 1)) == canonical, _luhn(F.concat(
        F.substr(canonical, F.lit(1), F.lit(1)), F.substr(changed, F.lit(2), size - 2)))).otherwise(changed)
    area = F.greatest(size - 10, F.lit(0))
    phone = F.concat(F.substr(canonical, F.lit(1), area), _substitute(F.substr(canonical, area + 1), stream))
    iban = _iban(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(changed, F.lit(5)))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "family", _family(canonical, stream, attempt))
            .when(kind == "given", _given(canonical, stream, attempt)).otherwise(changed))


def written(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the way the entity is written: its separators, its capitals."""
    plain = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    poured = _map_chars(entity, lambda c, k: F.when(F.regexp_like(c, F.lit("[0-9A-Za-z]")), F.substr(
        surrogate, F.length(F.regexp_replace(F.substr(entity, F.lit(1), k + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))

    def capitals_of(part):
        drawn, own = (F.split_part(x, F.lit("@"), F.lit(part)) for x in (surrogate, entity))
        return _map_chars(drawn, lambda c, k: F.when(F.regexp_like(F.substr(own, k + 1, F.lit(1)), F.lit("[A-Z]")), F.upper(c)).otherwise(c))

    capitals = F.concat(capitals_of(1), F.lit("@"), capitals_of(2))
    return F.when(kind == "ip", surrogate).when(kind == "email", capitals).when(
        plain == "", surrogate).otherwise(poured)


def assign(entities: DataFrame, key: str, limit: int = 64) -> DataFrame:
    """(kind, canonical, surrogate) for the distinct (kind, canonical): drawn anew until no two of a kind are alike and none
    is one of the originals. A draw that clashes is repeated for all but the least original."""
    pending = materialise(entities.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0)), "pending")
    # A part of a name may be no original part of either kind, so that no replaced mention holds another original.
    parts = F.col("kind").isin("given", "family")
    kinds = F.when(parts, F.array(F.lit("given"), F.lit("family"))).otherwise(F.array("kind"))
    originals = pending.select(F.explode(kinds).alias("kind"), F.when(parts, F.substr("canonical", F.lit(3)))
                               .otherwise(F.col("canonical")).alias("surrogate")).distinct()
    settled = None
    for _ in range(limit):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        drawn = materialise(drawn, "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        free = first.join(originals, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = free.select("kind", F.col("first").alias("canonical"), "surrogate")
        settled = materialise(good if settled is None else settled.union(good), "settled")
        pending = materialise(pending.join(settled, ["kind", "canonical"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "pending")
        if pending.isEmpty():
            return settled
    raise ValueError(f"no distinct replacements for all entities after {limit} draws")


def persons(entities: DataFrame) -> DataFrame:
    """The parts of the names among (row, entity): family and given, each with the gender before it (given is null where there
    is none), and as they are written: title, given_text, family_text and the ending of a genitive."""
    entity = F.col("entity")
    name = F.regexp_replace(entity, TITLED, "")
    ending = F.regexp_extract(name, "['’]s?$", 0)
    words = F.split(F.regexp_replace(name, "['’]s?$", ""), " ")
    own = F.when(F.regexp_like(entity, F.lit(f"^(?:{ADDRESS['f']})\\b")), "f").when(
        F.regexp_like(entity, F.lit(f"^(?:{ADDRESS['m']})\\b")), "m").otherwise("n")
    parts = entities.filter(F.regexp_like(entity, F.lit(TITLED))).select(
        "row", "entity", F.regexp_extract(entity, TITLED, 0).alias("title"), own.alias("own"), ending.alias("ending"),
        F.when(F.size(words) > 1, words[0]).alias("given_text"), F.element_at(words, -1).alias("family_text"))
    parts = parts.withColumns({"family": F.lower("family_text"), "first": F.lower("given_text")})
    family, person = W.partitionBy("row", "family"), W.partitionBy("row", "family", "first")

    def said(gender):  # of the same person, or of this family where one of both has no given name
        return F.when(F.col("first").isNull(), F.max(F.col("own") == gender).over(family)).otherwise(
            F.max(F.col("own") == gender).over(person) | F.max((F.col("own") == gender) & F.col("first").isNull()).over(family))

    men, women = said("m"), said("f")
    gender = F.when(F.col("own") != "n", F.col("own")).when(men & ~women, "m").when(women & ~men, "f").otherwise("n")
    parts = parts.withColumn("gender", gender)  # before the family takes it
    return parts.withColumns({k: F.concat("gender", F.lit(":"), c) for k, c in (("given", "first"), ("family", "family"))}).drop("own", "first", "gender")


def _mentions(named: DataFrame, drawn: DataFrame) -> DataFrame:
    """(row, entity, instead, bare) of the names and of the ways in which a text may name the same persons without a title."""
    def of(kind):
        return drawn.filter(F.col("kind") == kind).select(F.col("canonical").alias(kind), F.col("surrogate").alias(f"new_{kind}"))

    found = named.join(of("family"), "family").join(of("given"), "given", "left")
    new = F.concat_ws(" ", F.initcap("new_given"), F.initcap("new_family"))
    old = F.concat_ws(" ", "given_text", "family_text")
    loud = (F.upper("family_text") == F.col("family_text"))
    whole = F.struct(F.col("entity").alias("entity"), F.concat("title", F.when(loud, F.upper(new)).otherwise(new), "ending").alias("instead"), F.lit(False).alias("bare"))

    def forms(text, instead):
        return [F.struct(c.alias("entity"), i.alias("instead"), F.lit(True).alias("bare")) for c, i in (
            (text, F.when(loud, F.upper(instead)).otherwise(instead)), (F.upper(text), F.upper(instead)), (F.initcap(F.lower(text)), instead))]

    out = found.select("row", F.inline(F.array(whole, *forms(old, new), *forms(F.col("family_text"), F.initcap("new_family")))))
    return out.groupBy("row", "entity").agg(F.min("instead").alias("instead"), F.max("bare").alias("bare"))


def surrogates(docs: DataFrame, key: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of `docs` with the entities of the text replaced; other columns as they are."""
    m, r, p = "m", "r", "p"
    while {m, r, p} & {c.lower() for c in docs.columns}:
        m, r, p = m + "_", r + "_", p + "_"
    text_of = F.col(f"`{text}`").cast("string")
    some = F.regexp_like(text_of, F.lit(ENTITY))
    row = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("text "), F.sha2(text_of, 256)))
    found = F.array_distinct(F.regexp_extract_all(text_of, F.lit(ENTITY), F.lit(0)))
    entities = materialise(docs.filter(some).select(row.alias("row"), F.explode(found).alias("entity")), "entities")
    named = materialise(persons(entities.distinct()), "persons")
    known = entities.filter(~F.regexp_like("entity", F.lit(TITLED))).select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    known = materialise(known.withColumn("canonical", canonical_of(F.col("kind"), F.col("entity"))), "known")
    parts = named.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("canonical")) for k in ("family", "given")])).alias("p"))
    drawn = assign(known.select("kind", "canonical").unionByName(parts.select("p.*").filter("canonical IS NOT NULL")), key)
    instead = known.join(drawn, ["kind", "canonical"]).select("entity", written(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("instead"))
    instead = materialise(instead, "surrogates")
    plain = entities.distinct().join(instead, "entity").select("row", "entity", "instead", F.lit(False).alias("bare"))
    # A document's own entities and their replacements: as many as its text holds.
    bare = F.collect_list(F.when(F.col("bare"), F.struct((-F.length("entity")).alias("n"), "entity")))
    bare = F.array_join(F.transform(F.array_sort(bare), lambda x: x.entity), "|")
    # Bare names are looked for behind all entities, the longest first.
    pattern = F.when(bare == "", F.lit(ENTITY)).otherwise(F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])(?:"), bare, F.lit(r")(?![\p{L}\p{N}_])")))
    lists = plain.unionByName(_mentions(named, drawn)).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "instead"))).alias(m), pattern.alias(p))
    between = F.split(text_of, F.col(p), -1)
    within = F.regexp_extract_all(text_of, F.col(p), F.lit(0))
    # Zipped, so that neither list is computed again for each piece.
    rebuilt = F.array_join(F.zip_with(between, within, lambda s, w: F.concat(s, F.coalesce(F.element_at(F.col(m), w), w, F.lit("")))), "")
    touched = docs.filter(some).withColumn(r, row).join(lists.withColumnRenamed("row", r), r)
    columns = [F.when(F.lit(True), rebuilt).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    rest = docs.filter(F.coalesce(~some, F.lit(True)))
    return touched.select(*columns).unionByName(rest)
