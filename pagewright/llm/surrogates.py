"""Personal data: keyed surrogates, in DataFrame operations only.

Entities are found by one pattern, run once over every text.  What identifies an entity is its letters
and digits without separators and case, so the same number written in two ways is one entity.  Its surrogate
is drawn by a keyed hash: digits become digits, letters letters of the same script and case, separators
stay; octets of addresses stay octets, and a card number that passes its check keeps passing it.  Of a name
after a title every word is an entity of its own, a given name or a family name, so a person named in full
and by the family name alone keeps one family name; given names have the gender of the title.

Surrogates of different entities are made to differ, from each other and from every entity of the corpus:
those that collide are drawn again, and from the eighth time on get longer, so that a format with few
values, or a full one, never runs out.  So equal entities have equal surrogates everywhere, and different
ones different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)"
#: A run of such characters is tried from its beginning only, so long ones cost no more than their length.
EMAIL = r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
SECRET = r"(?<![\p{L}\d])[0-9a-fA-F]{32,64}(?![\p{L}\d])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\d])"
CARD = r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])"
#: Titles by gender (fixed values); a name follows.
MALE, FEMALE = ("Mr.", "Mr", "Herr", "Sr.", "M.", "Господин"), ("Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Sra.", "Mme", "Госпожа")
_TITLES = "|".join(t.replace(".", r"\.") for t in sorted((*MALE, *FEMALE), key=len, reverse=True))
NAME = rf"(?<![\p{{L}}\d])(?:{_TITLES}) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
PATTERN = "|".join((EMAIL, SECRET, IP, PHONE, SSN, IBAN, CARD, NAME))
#: Parts of invented names by gender and script; every beginning goes with every ending.
_NAME_PARTS = {
    "given_m_latin": ("Adel Arn Bert Carl Dor Em Fern Ger Hect Jul Konr Leon Mar Norb Osc Rold", "o us in ian ard"),
    "given_f_latin": ("Adel Ann Bert Clar Dor Em Fern Gret Helen Jul Kar Leon Mar Nor Ros Silv", "a ia ina ette ella"),
    "given_m_cyrillic": ("Ант Бор Вал Глеб Ден Ев Ил Кир Лев Мак Ник Ром", "ан ий ислав ор"),
    "given_f_cyrillic": ("Ант Бор Вал Гал Дар Ев Ир Кир Лид Мар Ник Ром", "ина ия ислава ея"),
    "family_latin": ("Ald Bar Cor Dahl El Fos Grun Hart Kess Lind Mor Nor Quil Ren Stav Thorn Veld Wick", "ell er man mark sen stein ton wood"),
    "family_m_cyrillic": ("Анд Бел Вол Гор Дем Зим Кар Лаз Мор Ник Пол Сав", "ов ин енов ский"),
    "family_f_cyrillic": ("Анд Бел Вол Гор Дем Зим Кар Лаз Мор Ник Пол Сав", "ова ина енова ская"),
}
NAMES = {k: tuple(x + y for x in first.split() for y in last.split()) for k, (first, last) in _NAME_PARTS.items()}
#: Letters of scripts: a pattern for the script, and what is drawn for a letter of it (other letters: a to z).
SCRIPTS = (
    (r"[\u0400-\u04FF]", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    (r"[\u0370-\u03FF]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\u0590-\u05FF]", "".join(chr(c) for c in range(0x05D0, 0x05EB))),
    (r"[\u0600-\u06FF]", "".join(chr(c) for c in range(0x0628, 0x063B))),
    (r"[\u0900-\u097F]", "".join(chr(c) for c in range(0x0915, 0x093A))),
    (r"[\u0E00-\u0E7F]", "".join(chr(c) for c in range(0x0E01, 0x0E2F))),
    (r"[\u3040-\u309F]", "".join(chr(c) for c in range(0x304B, 0x3070))),
    (r"[\u30A0-\u30FF]", "".join(chr(c) for c in range(0x30AB, 0x30D0))),
    (r"[\uAC00-\uD7AF]", "".join(chr(c) for c in range(0xAC00, 0xAC00 + 28 * 80, 28))),
    (r"[\u3400-\u9FFF]", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 61 * 80, 61))),
)
#: Attempts in the form of the entity; later ones are longer.
SAME_FORM = 8
KINDS = ("email", "phone", "ip", "secret", "name", "iban", "ssn", "card")


def _q(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def kind(entity: str) -> str:
    """SQL for the type of an entity."""
    return (
        f"CASE WHEN {entity} LIKE '%@%' THEN 'email' WHEN {entity} RLIKE '^{_q(IP)}$' THEN 'ip' WHEN {entity} RLIKE '^[0-9a-fA-F]{{32,64}}$' THEN 'secret' WHEN {entity} RLIKE '^(?:{_q(_TITLES)}) ' THEN 'name' "
        f"WHEN {entity} RLIKE '^\\\\d{{3}}-\\\\d{{2}}-\\\\d{{4}}$' THEN 'ssn' WHEN {entity} RLIKE '^[A-Z]{{2}}\\\\d{{2}}' THEN 'iban' WHEN {entity} RLIKE '^[+(]|^\\\\d{{3}}-\\\\d{{3}}-\\\\d{{4}}$' THEN 'phone' ELSE 'card' END"
    )


def canonical(entity: str, type_: str) -> str:
    """SQL for what identifies an entity: dots of addresses and the place of an @ count, other separators and case don't."""
    return f"CASE WHEN {type_} IN ('ip', 'email') THEN lower({entity}) ELSE lower(regexp_replace({entity}, '[^\\\\p{{L}}\\\\d]', '')) END"


def parts(entity: str, type_: str) -> str:
    """SQL for the array of (type, canon) of an entity: one, or one for each word of a name after its title."""
    female = "|".join(t.replace(".", r"\.") for t in FEMALE)
    gender = f"CASE WHEN {entity} RLIKE '^(?:{_q(female)}) ' THEN 'f' ELSE 'm' END"
    word = f"CASE WHEN i + 1 < size(z) THEN concat('given_', {gender}) WHEN w RLIKE '[\\\\u0400-\\\\u04FF]' THEN concat('family_', {gender}) ELSE 'family' END"
    words = f"transform(array(slice(split({entity}, ' '), 2, 9)), z -> transform(z, (w, i) -> named_struct('type', {word}, 'canon', w)))[0]"
    return f"CASE WHEN {type_} = 'name' THEN {words} ELSE array(named_struct('type', {type_}, 'canon', {canonical(entity, type_)})) END"


def _luhn(digits: str, skip_last: bool) -> str:
    """SQL for the weighted digit sum of a string of digits; without its last digit if asked."""
    d = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT)"
    return f"aggregate(sequence({1 if skip_last else 0}, length({digits}) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"


def drawn(key: str) -> Column:
    """The surrogate of (type, canon) at an attempt, by a keyed hash."""
    seed = f"sha2(concat_ws('|', '{_q(key)}', type, canon, CAST(attempt AS STRING)), 256)"
    byte = "CAST(conv(substring(z.h, 1 + (2 * i) % 62, 2), 16, 10) AS INT)"
    digit = f"CAST(CASE WHEN i = 0 AND c <> '0' THEN 1 + {byte} % 9 ELSE {byte} % 10 END AS STRING)"
    scripts = " ".join(f"WHEN c RLIKE '{_q(pattern)}' THEN substring('{letters}', 1 + {byte} % {len(letters)}, 1)" for pattern, letters in SCRIPTS)
    letter = f"CASE WHEN c < '\\u0370' THEN chr(97 + {byte} % 26) {scripts} ELSE chr(97 + {byte} % 26) END"
    char = f"CASE WHEN type = 'secret' THEN substring(z.h, 1 + i % 64, 1) WHEN c RLIKE '\\\\d' THEN {digit} WHEN c RLIKE '\\\\p{{L}}' AND NOT (type = 'iban' AND i < 2) THEN {letter} ELSE c END"
    # What a later attempt adds: as many characters of a hash as attempts beyond the first ones.
    extra = f"substring(sha2(concat(z.h, 'more'), 256), 1, greatest(0, attempt - {SAME_FORM - 1}))"
    digits = f"translate({extra}, 'abcdef', '012345')"
    letters = f"translate({extra}, '0123456789', 'ghijklmnop')"
    body = f"array_join(transform(split(z.s, ''), (c, i) -> {char}), '')"
    mail = f"concat({letters}, array_join(transform(split(regexp_replace(z.s, '\\\\.\\\\p{{L}}+$', ''), ''), (c, i) -> {char}), ''), regexp_extract(z.s, '\\\\.\\\\p{{L}}+$', 0))"
    octet = f"CASE WHEN length(c) = 3 OR attempt >= {SAME_FORM} THEN 100 + {byte} % 150 WHEN length(c) = 2 THEN 10 + {byte} % 90 ELSE {byte} % 10 END"
    octets = f"concat(array_join(transform(split(z.s, '[.]'), (c, i) -> CAST({octet} AS STRING)), '.'), CASE WHEN attempt >= {2 * SAME_FORM} THEN concat('/', {digits}) ELSE '' END)"
    lists = " ".join(f"WHEN '{k}' THEN array({', '.join(chr(39) + n + chr(39) for n in v)})" for k, v in NAMES.items())
    group = "concat(type, CASE WHEN z.s RLIKE '[\\\\u0400-\\\\u04FF]' THEN '_cyrillic' ELSE '_latin' END)"
    two = "CAST(conv(substring(z.h, 1, 6), 16, 10) AS INT)"
    # After a first collision names get further letters.
    script = "transform(sequence(1, least(attempt + 1, 24)), i -> transform(array(substring(z.s, -1, 1)), c -> " + letter + ")[0])"
    tail = f"CASE WHEN attempt > 0 THEN array_join({script}, '') ELSE '' END"
    named = f"concat(transform(array(CASE {group} {lists} END), n -> n[{two} % size(n)])[0], {tail})"
    checked = f"transform(array({body}), b -> CASE WHEN type = 'card' AND {_luhn('z.s', False)} % 10 = 0 THEN concat(substring(b, 1, length(b) - 1), CAST((10 - ({_luhn('b', True)}) % 10) % 10 AS STRING)) ELSE b END)[0]"
    longer = f"concat({checked}, CASE WHEN type = 'secret' THEN {extra} ELSE {digits} END)"
    return F.expr(f"transform(array(named_struct('h', {seed}, 's', canon)), z -> CASE WHEN type = 'email' THEN {mail} WHEN type = 'ip' THEN {octets} WHEN type LIKE 'given%' OR type LIKE 'family%' THEN {named} ELSE {longer} END)[0]")


def rendered(entity: str, type_: str, surrogates: str) -> str:
    """SQL for the surrogates of an entity's parts in its writing: its title, its separators and the case of its letters."""
    one = f"{surrogates}[0]"
    turned = f"CASE WHEN c RLIKE '\\\\p{{Lu}}' THEN upper(substring({one}, s.k, 1)) ELSE substring({one}, s.k, 1) END"
    cased = f"aggregate(split({entity}, ''), named_struct('o', '', 'k', 1), (s, c) -> CASE WHEN c RLIKE '[\\\\p{{L}}\\\\d]' OR {type_} IN ('email', 'ip') THEN named_struct('o', concat(s.o, {turned}), 'k', s.k + 1) ELSE named_struct('o', concat(s.o, c), 'k', s.k) END, s -> concat(s.o, substring({one}, s.k)))"
    return f"CASE WHEN {type_} = 'name' THEN concat_ws(' ', split({entity}, ' ')[0], array_join({surrogates}, ' ')) WHEN {type_} IN ('email', 'ip') AND length({one}) <> length({entity}) THEN {one} ELSE {cased} END"


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (type, canon) with surrogates: all different within a type, and none an entity of the corpus.

    Each round draws again those that collide, but the first of equals.  Surrogates grow from round to round
    in the end, so the rounds end.
    """
    known = materialize(entities.select("type", "canon").distinct())
    originals = known.select("type", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
    held = known.withColumn("attempt", F.lit(0)).withColumn("surrogate", drawn(key))
    turn = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("attempt", "canon"))
    while True:
        held = materialize(held.withColumn("turn", turn).join(originals, ["type", "surrogate"], "left").withColumn("bad", (F.col("turn") > 1) | F.col("taken").isNotNull()))
        if not held.filter("bad").limit(1).count():
            return held.select("type", "canon", "surrogate", "attempt")
        held = held.select("type", "canon", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "surrogate", "bad")
        held = held.withColumn("surrogate", F.when(F.col("bad"), drawn(key)).otherwise(F.col("surrogate"))).drop("bad")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text, ...) with all entities of the text replaced, and ``n_entities`` and ``kinds`` (sorted, distinct) added.

    Columns with these names are replaced.  Texts without entities, null and empty ones included, stay as they are.
    Repeated rows get equal texts, whatever their ids.  Whole texts are read, in a time that grows with their
    length.  An empty table gives an empty result.  ``key`` is secret: with it surrogates could be told from
    a list of guesses.
    """
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    names = {n: f"__{n}{'_' * max(map(len, docs.columns), default=0)}" for n in ("row", "found", "new", "kinds")}
    row, found, new, kinds = names.values()
    text = F.col("text").cast("string")
    listed = F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    # The pattern is run once; its results are written with the texts.
    read = materialize(docs.select(*(text.alias("text") if c == "text" else f"`{c}`" for c in keep), F.monotonically_increasing_id().alias(row), listed.alias(found)))
    some = read.filter(F.size(found) > 0)
    spread = some.select(row, F.posexplode(found).alias("at", "entity")).withColumn("kind", F.expr(kind("entity")))
    spread = spread.withColumn("parts", F.expr(parts("entity", "kind"))).select(row, "at", "entity", "kind", F.posexplode("parts").alias("place", "part"))
    spread = materialize(spread.select(row, "at", "entity", "kind", "place", "part.type", "part.canon"))
    mapped = spread.join(entity_surrogates(spread, key), ["type", "canon"])
    whole = mapped.groupBy(row, "at", "entity", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda s: s["surrogate"]).alias("drawn"))
    whole = whole.withColumn("new", F.expr(rendered("entity", "kind", "drawn")))
    per_row = whole.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda s: s["new"]).alias(new), F.array_sort(F.collect_set("kind")).alias(kinds))
    hit = some.join(per_row, row)
    pieces = F.split(F.col("text"), PATTERN, -1)
    replaced = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    columns = lambda value: [value.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep]
    changed = hit.select(*columns(replaced), F.size(found).cast("long").alias("n_entities"), F.col(kinds).alias("kinds"))
    plain = read.filter(F.size(found) == 0).select(*columns(F.col("text")), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return changed.unionByName(plain)
