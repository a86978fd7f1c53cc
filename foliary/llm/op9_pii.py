"""Surrogates for personal data and secrets, in DataFrame operations only.

Entities: e-mail addresses, phone numbers, IP addresses, card numbers (valid by Luhn), social security numbers, IBANs
(valid modulo 97), secrets (long hex strings and key formats), names after a form of address, and further mentions of such
a name in the same text. A surrogate is drawn by a keyed SHA-256 of type and value, so an entity has the same one wherever
it occurs. It keeps the format (length, punctuation, case, digits, country code, check digits), the script and, for names,
the gender; hosts end in the reserved domain `example`, IPv4 addresses lie in network 10, IPv6 addresses in fd00::/8,
social security numbers in area 9xx. Addresses of one host keep one host.

Names: a surname has one surrogate whatever the form of address; Russian feminine forms are those of the same surname. A
given name has one by gender; where the form of address names none, the gender is the one that the name mostly has in the
table. Surrogates of names are made of syllables, one more with every draw, so there are always enough of them.

Collision checks: the distinct entities of the whole table are given surrogates in rounds. A surrogate that is a real
entity, or that another entity has or draws, is not taken; the entity draws again. Distinct entities thus stay distinct.

The patterns run once over each text; what they find is written to the shared folder. Texts without entities are passed on
as they are. Others are joined with their surrogates by a digest of the text, so copies share the work, and only they are
shuffled. A winner among equal draws is a minimum, which Spark combines before its shuffle, and joins on hot entities are
ones that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import cut, staged, table

#: The session setting that holds the key; without it, surrogates are those of TEST_KEY, which protects nothing.
KEY_SETTING, TEST_KEY = "spark.foliary.pii.key", "no key set"

#: Forms of address by gender.
MALE = ["Mr", "Herr", "Señor", "Monsieur", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа", "госпожа"]
NEUTRAL = ["Dr", "Prof"]
#: First, middle and last syllables of surrogates for names, by script and kind.
SYLLABLES = {
    "latin": ("Al Ber Cor Dan El Fer Gal Hel Is Jor Kar Lor Mar Nor Or Per Ros Sal Tor Val Wil Zel".split(), "a e i o an en in il el am ar er om ur iv ol".split()),
    "cyrillic": ("Ар Бор Вер Гал Дан Ел Жан Зор Ил Кар Лев Мар Нил Ор Пет Рог Сав Тар Ул Фед".split(), "а е и о ан ен ин ил ел ам ар ер ом ур ав ол".split()),
}
ENDS = {
    ("latin", "given_m"): "do no ro to mir bert win ric las mund".split(),
    ("latin", "given_f"): "da na ra ta lia nia ria sia lina tina".split(),
    ("latin", "given_n"): "dy ley ry sy ny lin rin sin len ren".split(),
    ("latin", "surname"): "mann berg son ford ville stein ley ton ini ez ski dal holt wood".split(),
    ("cyrillic", "given_m"): "дим мир слав рий вий тан лад ник".split(),
    ("cyrillic", "given_f"): "да на ра та лия ния рина сия".split(),
    ("cyrillic", "given_n"): "дим мир слав на ра лия ния рий".split(),
    ("cyrillic", "surname"): "денко ченко ренко тенко ших дых няк вич".split(),
    ("cyrillic", "surname_inflected"): "дов нов ров тов цев лев кин лин рин шин".split(),
}

PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,24}",
    "secret": r"(?<![\p{L}\p{N}_])(?:(?=[0-9a-f]*\d)[0-9a-f]{32,128}|(?=[0-9A-F]*\d)[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}_])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?=[A-Z0-9]*\d)[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\p{L}\p{N}-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,19})(?!\d)",
    "name": r"(?<!\p{L})(?:" + "|".join([*MALE, *FEMALE, *NEUTRAL]) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: Within a word only what begins with a digit can be an entity, which spares most places of a text the alternatives.
ANY = r"(?:(?<!\p{L})|(?=\d))(?:" + "|".join(PATTERNS.values()) + ")"
#: What any entity has: a digit, an @ or a form of address.
GATE = "[0-9@]|" + "|".join([*MALE, *FEMALE, *NEUTRAL])
#: A noncharacter that marks entities while a text is cut; texts that hold it are cut another way.
CUT = "\ufdd0"
PART = "struct<gap:string,kind:string,value:string,tail:string>"


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(value.rlike(_whole(k)), F.lit(k)).otherwise(out)
    return out


def _part(gap: Column, kind: Column | str | None, value: Column | None, tail: Column | str = "") -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(gap.alias("gap"), text(kind).alias("kind"), text(value).alias("value"), text(tail).alias("tail"))


def _surname(gap: Column, word: Column) -> Column:
    inflected = word.rlike("([оеё]в|[иы]н)а?$")
    stem = F.when(inflected, F.regexp_replace(word, "а$", F.lit(""))).otherwise(word)
    return _part(gap, F.when(inflected, "surname_inflected").otherwise("surname"), stem, F.substring(word, F.length(stem) + 1, F.lit(1)))


def entities(text: Column) -> Column:
    """Array of PART: what stands before an entity, its kind and value, and an ending that follows its surrogate; the last
    one, and those that are no entities after all, have a null value."""
    cut_up = F.split(F.regexp_replace(text, ANY, F.lit(f"{CUT}$0{CUT}")), CUT, -1)
    clean = ~F.contains(text, F.lit(CUT))
    found = F.when(clean, F.filter(cut_up, lambda x, i: i % 2 == 1)).otherwise(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    gaps = F.when(clean, F.filter(cut_up, lambda x, i: i % 2 == 0)).otherwise(F.split(text, ANY, -1))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))

    def one(x: Column) -> Column:
        gap, value, kind = x["gap"], x["value"], kind_of(x["value"])
        valid = (kind != "card") & (kind != "iban") | (kind == "card") & (luhn(F.regexp_replace(value, "[ -]", F.lit(""))) == 0) | (kind == "iban") & (mod97(value) == 1)
        plain = F.array(F.when(valid, _part(gap, kind, value)).otherwise(_part(F.concat(gap, value), None, None)))
        title = F.regexp_extract(value, r"^(\S+? )", 1)
        address = F.regexp_replace(title, r"\.? $", F.lit(""))
        gender = F.when(address.isin(MALE), "m").when(address.isin(FEMALE), "f").otherwise("n")
        words = F.split(F.regexp_replace(value, r"^\S+? ", F.lit("")), " ")
        last = _surname(F.when(F.size(words) > 1, F.lit(" ")).otherwise(F.concat(gap, title)), F.element_at(words, -1))
        first = _part(F.concat(gap, title), F.concat(F.lit("given_"), gender), F.element_at(words, 1))
        return F.when(kind == "name", F.when(F.size(words) > 1, F.array(first, last)).otherwise(F.array(last))).otherwise(plain)

    return F.concat(F.flatten(F.transform(pairs, one)), F.array(_part(F.element_at(gaps, -1), None, None))).cast(f"array<{PART}>")


def names(parts: Column) -> Column:
    """The names among the parts, each with the word that stands in the text."""
    some = F.filter(parts, lambda x: x["kind"].startswith("given") | x["kind"].startswith("surname"))
    return F.transform(some, lambda x: F.struct(F.concat(x["value"], x["tail"]).alias("word"), x["kind"].alias("kind"), x["value"].alias("value"), x["tail"].alias("tail")))


def with_mentions(parts: Column, known: Column) -> Column:
    """The parts, with further mentions of the names known as parts of their own."""
    words = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.array_distinct(F.transform(known, lambda x: x["word"])), "|"), F.lit(r")(?![\p{L}\p{N}_])"))

    def one(x: Column) -> Column:
        gaps, found = F.split(x["gap"], words, -1), F.regexp_extract_all(x["gap"], words, F.lit(0))

        def mention(v: Column, i: Column) -> Column:
            n = F.get(F.filter(known, lambda y: y["word"] == v), F.lit(0))
            return _part(F.get(gaps, i), n["kind"], n["value"], n["tail"])

        return F.concat(F.transform(found, mention), F.array(_part(F.element_at(gaps, -1), x["kind"], x["value"], x["tail"])))

    return F.when(F.size(known) == 0, parts).otherwise(F.flatten(F.transform(parts, one)).cast(f"array<{PART}>"))


def _draw(digest: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(F.xxhash64(digest, i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYR_LOW, _CYR_UP = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
_OTHER_LOW, _OTHER_UP = "áâäåæçèéêëíîïñóôöøùúûü", "ÁÂÄÅÆÇÈÉÊËÍÎÏÑÓÔÖØÙÚÛÜ"


def alike(value: Column, digest: Column, low: str = _LOW, up: str = _UP) -> Column:
    """Every digit and letter replaced by another of its class: digits, case, and Latin, Cyrillic or accented letters."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _draw(digest, i, _DIGITS)).when(c.rlike("[a-z]"), _draw(digest, i, low)).when(c.rlike("[A-Z]"), _draw(digest, i, up))
        out = out.when(c.rlike("[а-яё]"), _draw(digest, i, _CYR_LOW)).when(c.rlike("[А-ЯЁ]"), _draw(digest, i, _CYR_UP))
        return out.when(c.rlike(r"\p{Ll}"), _draw(digest, i, _OTHER_LOW)).when(c.rlike(r"\p{Lu}"), _draw(digest, i, _OTHER_UP)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(digits: Column) -> Column:
    """The checksum modulo 10; 0 for a valid number."""

    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), one) % 10


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN; 1 for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def one(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), one)


def _pick(digest: Column, i: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(F.xxhash64(digest, i), F.lit(len(names))).cast("int") + 1)


def name_like(kind: str, cyrillic: Column, digest: Column, attempt: Column) -> Column:
    """A name of syllables, of a middle one more with every attempt."""

    def of(script: str) -> Column:
        firsts, middles = SYLLABLES[script]
        ends = ENDS.get((script, kind)) or ENDS[script, "surname"]
        inner = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 1), lambda i: _pick(digest, i, middles)), "")
        return F.concat(_pick(digest, F.lit(0), firsts), inner, _pick(digest, F.lit(-1), ends))

    return F.when(cyrillic, of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The attempt-th draw for an entity. Later attempts leave short lists and formats, so that rounds come to an end."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), value), 256)
    like = alike(value, digest)
    more = F.when(attempt >= 8, F.concat(F.lit("."), attempt.cast("string"))).otherwise(F.lit(""))
    local, host = F.substring_index(value, "@", 1), F.regexp_replace(F.substring_index(value, "@", -1), r"\.\p{L}+$", F.lit(""))
    tld = F.when(value.rlike(r"\p{Ll}"), F.lit(".example")).otherwise(F.lit(".EXAMPLE"))
    of_host = F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.lower(host)), 256)
    email = F.concat(alike(local, digest), more, F.lit("@"), alike(host, of_host), tld)
    byte = lambda n: F.pmod(F.xxhash64(digest, F.lit(n)), F.lit(256)).cast("string")
    net = F.when(attempt < 8, F.lit("10")).otherwise((240 + F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(15))).cast("string"))
    ip = F.concat_ws(".", net, byte(1), byte(2), byte(3))
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=\D)|\+\d)", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    opened = F.regexp_extract(rest, r"^(\D*)", 1)
    phone = F.concat(code, opened, _draw(digest, F.lit(-1), "23456789"), alike(F.substring(rest, F.length(opened) + 2, F.length(rest)), digest))
    drawn = F.concat(F.substring(value, 1, 1), alike(F.substring(value, F.lit(2), F.length(value)), digest))
    zero = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    bare = lambda v: F.regexp_replace(v, "[ -]", F.lit(""))
    valid = F.concat(F.substring(zero, F.lit(1), F.length(zero) - 1), ((10 - luhn(bare(zero))) % 10).cast("string"))
    card = F.when(luhn(bare(value)) == 0, valid).otherwise(drawn)
    ssn = F.concat(F.lit("9"), alike(F.substring(value, 2, 10), digest))
    prefix = F.regexp_extract(value, "^(AKIA|sk-|gh[pousr]_)", 1)
    secret = F.when(prefix != "", F.concat(prefix, alike(F.substring(value, F.length(prefix) + 1, F.length(value)), digest))).otherwise(alike(value, digest, "abcdef", "ABCDEF"))
    open_ = F.concat(F.substring(value, 1, 2), F.lit("00"), alike(F.substring(value, F.lit(5), F.length(value)), digest))
    iban = F.concat(F.substring(value, 1, 2), F.lpad((98 - mod97(open_)).cast("string"), 2, "0"), F.substring(open_, F.lit(5), F.length(value)))
    ipv6 = F.concat(F.lit("fd"), F.regexp_replace(alike(value, digest, "abcdef", "ABCDEF"), "^[0-9A-Fa-f]+", F.lit("00")))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "secret", secret).when(kind == "iban", iban)
    cyrillic = value.rlike("[А-Яа-яЁё]")
    for name in ("given_m", "given_f", "given_n", "surname", "surname_inflected"):
        out = out.when(kind == name, name_like(name, cyrillic, digest, attempt))
    return out.otherwise(like)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value) to (kind, value, s): distinct surrogates, none of which is the value of an entity. A given name of no
    gender has the surrogate of the gender that it has in most rows (male of equally many), if any."""
    counted = cut(entities.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    of = lambda g: F.coalesce(F.sum(F.when(F.col("kind") == f"given_{g}", F.col("n"))), F.lit(0))
    genders = counted.where("kind LIKE 'given%'").groupBy("value").agg(of("m").alias("m"), of("f").alias("f"))
    genders = genders.where("m + f > 0").select("value", F.when(F.col("m") >= F.col("f"), "given_m").otherwise("given_f").alias("known"))
    named = counted.join(genders, "value", "left").select("kind", "value", F.when(F.col("kind") == "given_n", F.coalesce("known", "kind")).otherwise(F.col("kind")).alias("as"))
    known = cut(named.select(F.col("as").alias("kind"), "value").distinct())
    real = known.select(F.col("value").alias("s")).distinct()
    todo, attempt, done = known, 0, None
    while True:
        drawn = cut(todo.withColumn("s", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)))
        free = drawn.join(real, "s", "left_anti")
        if done is not None:
            free = free.join(done.select("s"), "s", "left_anti")
        won = cut(free.groupBy("s").agg(F.min(F.struct("kind", "value")).alias("e")).select("e.kind", "e.value", "s"))
        done = won if done is None else done.unionAll(won)
        todo = cut(todo.join(won, ["kind", "value"], "left_anti"))
        if todo.isEmpty():
            return named.join(done.withColumnRenamed("kind", "as"), ["as", "value"]).select("kind", "value", "s")
        attempt += 1


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the entities of text_col replaced, all columns and rows kept; count_col, if given, is added with the number of
    entities replaced.

    Null and blank texts stay as they are, as do texts without entities. Repeated rows and copies get equal results. Of
    overlapping candidates the leftmost is taken, at one place the first kind of PATTERNS. Texts of any length are read as a
    whole, each in one row. Further mentions of a name count only as whole words written as in the name. An empty table
    stays empty; other columns are kept, whatever their names, but one named count_col is replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, count_col)]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("none"))
    rows = docs.select(rest.alias("rest"), F.col(f"`{text_col}`").alias("t"))
    rows = rows.select("rest", "t", F.when(F.col("t").rlike(GATE), entities(F.col("t"))).alias("p"))
    some = F.exists("p", lambda x: x["value"].isNotNull())
    rows = rows.select("rest", "t", F.when(some, with_mentions(F.col("p"), names(F.col("p")))).alias("p"))
    whole = F.col("p").isNull()
    values = F.transform("p", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    shown = F.transform("p", lambda x: F.struct(x["gap"].alias("gap"), x["tail"].alias("tail")))
    found = staged(rows.select("rest", F.when(whole, F.col("t")).alias("t"), F.when(~whole, F.md5("t")).alias("k"), values.alias("e"), shown.alias("p")))
    plain, changed = found.where("k IS NULL"), found.where("k IS NOT NULL")
    texts = cut(changed.groupBy("k").agg(F.first("e").alias("e")))
    each = texts.select("k", F.posexplode("e").alias("i", "e")).select("k", "i", "e.kind", "e.value").where("value IS NOT NULL")
    given = each.join(assign(each, key), ["kind", "value"])
    by_text = given.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("s"))
    joined = changed.join(by_text, "k")
    new = F.array_join(F.transform("p", lambda x, i: F.concat(x["gap"], F.coalesce(F.concat(F.try_element_at(F.col("s"), i), x["tail"]), F.lit("")))), "")
    both = plain.select("rest", "t", F.lit(0).cast("long").alias("n")).unionAll(joined.select("rest", new, F.size("s").cast("long")))
    at = {c: F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(kept)} | {text_col: F.col("t").alias(text_col)}
    return both.select(*[at[c] for c in docs.columns if c != count_col], *([F.col("n").alias(count_col)] if count_col else []))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_entities): every document with its entities replaced, as pseudonymize() does."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, key_of(spark), count_col="n_entities")
