"""Surrogates for personal data (DataFrame functions only).

Entities found by patterns get replacements drawn from a keyed hash of the entity, so equal entities have equal
replacements everywhere (coreference) without a shared table. Replacements keep the type, the format (length, case,
punctuation, check digits), the script of letters, and the gender that a title shows. All distinct entities are then
checked: a replacement that another entity also got, or that is itself an entity of the corpus, is drawn again until none
is left; only those few exceptions are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, null_safe, saved

# fixed values: titles by gender, name syllables by script, and the alphabets replacements are drawn from
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа"), "n": ("Dr", "Prof")}
SYLLABLES = {
    "latin": ("ba", "be", "co", "da", "de", "el", "fa", "fi", "ga", "ha", "jo", "ka", "la", "le", "li", "ma", "mi", "na", "ni", "or", "ra", "re", "ri", "sa", "si", "ta", "ti", "va", "vi", "wi", "ye", "zo"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "да", "де", "жи", "за", "зи", "ка", "ки", "ла", "ле", "ли", "ма", "ми", "на", "ни", "ол", "па", "ра", "ре", "ри", "са", "се", "та", "ти", "фа", "хо", "ча", "ша"),
}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "e"}, "cyrillic": {"m": "ов", "f": "ова", "n": "ко"}}
ALPHABETS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[а-я]", "абвгдежзийклмнопрстуфхцчшщыэюя"), ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"), (r"\p{Ll}", "àáâãäåæçèéêëìíîïñòóôõöøùúûü"), (r"\p{Lu}", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"))

EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
NAME = r"(?<![\p{L}])(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
ENTITY = "|".join((EMAIL, SECRET, ADDRESS, PHONE, CARD, NAME))


def kind_of(entity: Column) -> Column:
    """email, secret, address, phone, card or name."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return F.when(F.contains(entity, F.lit("@")), "email").when(whole(CARD), "card").when(whole(r"[0-9]+(?:\.[0-9]+){3}"), "address").when(entity.rlike(r"^[+(]"), "phone").when(whole("[0-9A-Fa-f]{32,}"), "secret").otherwise("name")


def _byte(digest: Column, i: Column) -> Column:
    """A number below 4096 from a hexadecimal digest, by position."""
    return F.conv(F.substring(digest, F.pmod(i * 3, F.lit(125)) + 1, F.lit(3)), 16, 10).cast("int")


def _redrawn(value: Column, digest: Column, alphabets=ALPHABETS) -> Column:
    """Letters and digits replaced within their alphabet, position by position; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, alphabet in reversed(alphabets):
            out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(alphabet), F.pmod(_byte(digest, i), F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of 16 digits, the last one counted as it is."""
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x)


def _card(value: Column, digest: Column) -> Column:
    """The same first digit and grouping; the check digit is right if it was right before."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    drawn = F.concat(F.substring(digits, 1, 1), F.substring(_redrawn(digits, digest), 2, 15))
    check = lambda d: F.pmod(10 - F.pmod(_luhn_sum(F.concat(F.substring(d, 1, 15), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    fixed = F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, F.concat(F.substring(drawn, 1, 15), check(drawn))).otherwise(drawn)
    mark = F.regexp_extract(value, "[^0-9]", 0)
    return let(fixed, lambda d: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), mark)))


def _name(value: Column, digest: Column) -> Column:
    """The title stays; each name becomes three or four syllables of its script with an ending for the title's gender."""
    title = F.regexp_extract(value, r"^[^ ]+", 0)
    plain = F.regexp_replace(title, r"\.$", "")
    gender = F.when(plain.isin(*TITLES["m"]), "m").when(plain.isin(*TITLES["f"]), "f").otherwise("n")

    def word(part: Column, at: Column) -> Column:
        def composed(script: str) -> Column:
            pick = lambda j: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[script]]), F.pmod(_byte(digest, at * 5 + j), F.lit(len(SYLLABLES[script]))) + 1)
            ending = F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS[script].items() for x in kv]), gender)
            return F.initcap(F.concat(pick(0), pick(1), pick(2), pick(3), ending))

        return F.when(part.rlike("[А-Яа-я]"), composed("cyrillic")).otherwise(composed("latin"))

    parts = F.slice(F.split(value, " "), 2, 3)
    return F.concat(title, F.lit(" "), F.array_join(F.transform(parts, word), " "))


def surrogate(entity: Column, secret: str, attempt: Column | int = 0) -> Column:
    """The replacement of an entity at an attempt (0, 1, ..), under a secret key."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    core = F.when(kind_of(entity) == "name", F.regexp_replace(entity, r"^[^ ]+ ", "")).otherwise(entity)
    keyed = lambda v: F.sha2(F.encode(F.concat_ws("|", F.lit(secret), v, attempt.cast("string")), "UTF-8"), 512)
    digest = keyed(core)

    def drawn(h: Column) -> Column:
        kind = kind_of(entity)
        local, domain = F.regexp_extract(entity, "^([^@]*)@", 1), F.regexp_extract(entity, "@(.*)$", 1)
        host, top = F.regexp_extract(domain, r"^(.*?)((?:\.example)?\.[^.]*)$", 1), F.regexp_extract(domain, r"^(.*?)((?:\.example)?\.[^.]*)$", 2)
        email = F.concat(_redrawn(local, h), F.lit("@"), _redrawn(host, F.sha2(F.encode(F.concat_ws("|", F.lit(secret), domain), "UTF-8"), 512)), top)
        octets = F.concat_ws(".", (F.pmod(_byte(h, F.lit(0)), F.lit(223)) + 1).cast("string"), *[F.pmod(_byte(h, F.lit(i)), F.lit(256)).cast("string") for i in (1, 2, 3)])
        country = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ (-])", 0)
        phone = F.concat(country, _redrawn(F.substring(entity, F.length(country) + 1, F.length(entity)), h))
        hexes = (("[0-9]", "0123456789"), ("[a-f]", "abcdef"), ("[A-F]", "ABCDEF"))
        return F.when(kind == "email", email).when(kind == "address", octets).when(kind == "phone", phone).when(kind == "card", _card(entity, h)).when(kind == "secret", _redrawn(entity, h, hexes)).otherwise(_name(entity, h))

    return let(digest, drawn)


def exceptions(entities: DataFrame, secret: str, most: int = 64) -> DataFrame:
    """entities: distinct (entity). (entity, attempt, surrogate) of those whose replacement had to be drawn again. In
    each round the smallest of the entities that share a replacement keeps it."""
    drawn = saved(entities.select("entity", F.lit(0).alias("attempt"), surrogate(F.col("entity"), secret).alias("surrogate")), "surrogates")
    for attempt in range(1, most):
        shared = drawn.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("attempt"), F.col("entity"))).alias("keeper")).where("n > 1")
        again = drawn.join(shared, "surrogate").where(F.struct("attempt", "entity") != F.col("keeper")).select("entity")
        taken = drawn.join(entities.select(F.col("entity").alias("surrogate")), "surrogate", "left_semi").select("entity")
        bad = saved(again.unionByName(taken).distinct(), "collisions")
        if bad.isEmpty():
            break
        redrawn = bad.select("entity", F.lit(attempt).alias("attempt"), surrogate(F.col("entity"), secret, attempt).alias("surrogate"))
        drawn = saved(drawn.join(bad, "entity", "left_anti").unionByName(redrawn), "surrogates")
    else:
        raise ValueError(f"replacements still collide after {most} draws")
    return saved(drawn.where("attempt > 0"), "exceptions")


def pseudonymised(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = "corpus-key") -> DataFrame:
    """One row per row of docs: key, n_entities, kinds (distinct, sorted, comma-joined), text with the replacements.

    A null text stays null and has no entities; an empty one stays empty. Repeated rows get equal results, as do equal
    entities anywhere. Null keys are keys. An empty table gives no rows. Other columns aren't read.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ENTITY), F.lit(0))
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    entities = saved(docs.select(F.explode(found).alias("entity")).distinct(), "entities")
    odd = exceptions(entities, secret)
    rows = rows.withColumn("__h", F.xxhash64("text"))
    if odd.isEmpty():
        rows = rows.withColumn("__odd", F.lit(None).cast("map<string,string>"))
    else:
        touched = rows.select(key, "__h", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY), F.lit(0)))).alias("entity")).distinct().join(odd, "entity")
        touched = saved(touched.groupBy(key, "__h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("__odd")), "touched")
        rows = null_safe(rows, touched, [key, "__h"], "left")
    replaced = lambda e: F.coalesce(F.try_element_at(F.col("__odd"), e), surrogate(e, secret))
    matches = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY), F.lit(0))

    def built(m: Column) -> Column:
        pieces = F.split(F.col("text"), ENTITY, -1)
        joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(m), F.concat(p, replaced(F.get(m, i)))).otherwise(p)), "")
        return F.struct(F.size(m).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform(m, kind_of))), ",").alias("kinds"), F.when(F.size(m) == 0, F.col("text")).otherwise(joined).alias("text"))

    return rows.select(key, let(matches, built).alias("r")).select(key, "r.n_entities", "r.kinds", F.col("r.text").alias("surrogate_text"))
