"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "Госпожа")
#: Titles that tell no gender.
_EITHER = ("Dr", "Prof")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = "\\p{Lu}[\\p{L}'-]+"
_DATE = "(?!(?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:19|20)[0-9]{2}(?![0-9]))"
#: Phones, tried in turn: ten digits as 3-3-4; '+' and 8 to 15 digits with single separators or one bracket; an area in
#: brackets; 9 to 12 digits from a leading 0, unless they begin as a date; an area and 3-3 or 3-4 digits; a local 3-4.
_PHONES = (
    "(?:\\+1[ .-]?)?[0-9]{3}[ .-]?[0-9]{3}[ .-][0-9]{4}", "(?:\\+[0-9]{1,3}[ .-]?)?\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}",
    "\\+[0-9](?:[ ./-]?[0-9]){7,14}", "\\+[0-9]{1,3}[ ./-]?\\([0-9]{1,5}\\)(?:[ ./-]?[0-9]){5,11}",
    "\\((?!(?:19|20)[0-9]{2}\\))[0-9]{2,5}\\)(?:[ ./-]?[0-9]){6,10}", f"{_DATE}0[0-9](?:[ ./-]?[0-9]){{7,10}}",
    "(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{3,4}", "(?<![0-9][.-])[2-9][0-9]{2}-[0-9]{4}(?!-[0-9])",
)
#: Country codes; none begins another.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: A domain name has at most 127 labels. Each pattern with the characters it can begin with; none begins behind a letter or digit.
PATTERNS = {
    "email": ("[A-Za-z0-9._%+-]", "(?<![._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    "iban": ("[A-Z]", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": ("[0-9]", f"(?<!\\.)(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9A-Za-z]|\\.[0-9])"),
    "card": ("[0-9]", "[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "ssn": ("[0-9]", "(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "phone": ("[0-9(+]", f"(?<!\\+)(?:{'|'.join(_PHONES)})(?![0-9A-Za-z])"),
    "name": ("[A-ZГг]", f"(?<!\\p{{L}})(?:{'|'.join(sorted(_MALE + _FEMALE + _EITHER, key=len, reverse=True))})\\.? {_NAME}(?: {_NAME})?"),
}
#: One look at the character before and one at the first character leave most positions of a text at once.
ENTITY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?={first}){rest}" for first, rest in PATTERNS.values()) + ")"
#: Consonants and vowels that surrogate names alternate.
_LETTERS = {"Latin": ("bdfgklmnprstvz", "aeiou"), "Cyrillic": ("бвгдзклмнпрст", "аеиоу"), "Greek": ("βγδζκλμνπρστ", "αεηιο")}
MOST_TRIES = 64
#: Set before what looks like a card or an IBAN but has wrong check digits: a number of another kind, left as it is.
_NOT = "\u0000"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(body: Column, last_counts: int) -> Column:
    """Sum of the digits, every second one from the end doubled; ``last_counts`` is 1 or 2, the weight of the last."""
    def worth(c, i):
        d = c.cast("int") * F.when((F.length(body) - i) % 2 == 1, last_counts).otherwise(3 - last_counts)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(body, ""), worth), F.lit(0), lambda a, d: a + d)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, A standing for 10."""
    def step(rest, c):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def checked(e: Column) -> Column:
    """``e``, marked as no entity if it has the form of a card or an IBAN but not their check digits."""
    bare, digits = F.replace(e, F.lit(" "), F.lit("")), _digits(e)
    wrong = (
        F.when(F.contains(e, F.lit("@")), False)
        .when(e.rlike("^[A-Z]{2}[0-9]{2}"), _mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) != 1)
        .when(e.rlike("^[1-9]") & (F.length(digits) >= 13) & ~e.rlike("[^0-9 -]"), _luhn_sum(digits, 1) % 10 != 0).otherwise(False)
    )
    return F.when(wrong, F.concat(F.lit(_NOT), e)).otherwise(e)


def kind_of(e: Column) -> Column:
    return (
        F.when(F.startswith(e, F.lit(_NOT)), "none").when(F.contains(e, F.lit("@")), "email").when(e.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(e.rlike("^\\p{L}"), "name")
        .when(e.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$"), "ip").when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when((F.length(_digits(e)) >= 13) & ~e.rlike("^[+(0]"), "card").otherwise("phone")
    )


def _script(s: Column) -> Column:
    return F.when(s.rlike("\\p{IsCyrillic}"), "Cyrillic").when(s.rlike("\\p{IsGreek}"), "Greek").otherwise("Latin")


def identities(e: Column) -> Column:
    """What an occurrence refers to: structs (kind, canon); a name refers to its given and its family name."""
    def one(kind, canon):
        return F.struct(kind.alias("kind"), canon.alias("canon"))

    kind, parts = kind_of(e), F.split(e, " ")
    title = F.regexp_replace(parts[0], "\\.", "")
    gender = F.when(title.isin(*_MALE), "m").when(title.isin(*_EITHER), "n").otherwise("f")
    given, family = F.lower(F.get(parts, F.lit(1))), F.lower(F.element_at(parts, -1))
    family_of = one(F.concat(F.lit("family:"), _script(family)), family)
    given_of = one(F.concat(F.lit("given:"), gender, F.lit(":"), _script(given)), given)
    # The code by the numbering plan, or what is set off if that is shorter.
    planned, apart = F.regexp_extract(_digits(e), f"^(?:{_COUNTRY})", 0), F.regexp_extract(e, "^\\+([0-9]{1,3})[ ./(-]", 1)
    country = F.when(~F.startswith(e, F.lit("+")), "").when(apart.isNotNull() & (apart != "") & (F.length(apart) < F.length(planned)), apart).otherwise(planned)
    canon = (
        F.when(kind == "email", F.lower(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "ip", e)
        .when(kind == "phone", F.concat(country, F.lit(":"), F.substr(_digits(e), F.length(country) + 1))).otherwise(_digits(e))
    )
    return (
        F.when(kind == "none", F.slice(F.array(one(kind, canon)), 1, 0)).when((kind == "name") & (F.size(parts) > 2), F.array(given_of, family_of)).when(kind == "name", F.array(family_of))
        .otherwise(F.array(one(kind, canon)))
    )


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _mapped(s: Column, digest: Column) -> Column:
    """Every digit by a keyed digit, every ASCII letter by a keyed letter of its case; the rest as it is."""
    def swap(c, i):
        n = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), swap), "")


def _luhn(body: Column) -> Column:
    """``body`` and its check digit."""
    return F.concat(body, F.pmod(-_luhn_sum(body, 2), F.lit(10)).cast("string"))


def surrogate(kind: Column, canon: Column, tries: Column, key: str) -> Column:
    """The canonical form of the replacement of (kind, canon) at its n-th try."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, tries.cast("string")), 256)
    local, domain = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(canon, F.lit("@"), F.lit(2))
    host = F.translate(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), F.lit(1), F.lit(12)), "0123456789", "ghijklmnop")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string")), ".")
    country, rest = F.split_part(canon, F.lit(":"), F.lit(1)), F.split_part(canon, F.lit(":"), F.lit(2))
    first, trunk = _pick("23456789", _byte(digest, F.lit(31))), F.regexp_extract(rest, "^0{0,2}", 0)
    card = _luhn(F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(_mapped(canon, digest), F.lit(2), F.length(canon) - 2)))
    account = F.substr(_mapped(canon, digest), F.lit(5))
    check = F.lpad((98 - _mod97(F.concat(account, F.substr(canon, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    size = F.greatest(F.lit(4), F.length(canon)) + tries

    def name(script):
        consonants, vowels = _LETTERS[script]
        at = F.sequence(F.lit(0), size - 1)
        raw = F.array_join(F.transform(at, lambda i: F.when(i % 2 == 0, _pick(consonants, _byte(digest, i))).otherwise(_pick(vowels, _byte(digest, i)))), "")
        female, male = F.concat(raw, F.lit(vowels[0])), F.concat(raw, _pick(consonants, _byte(digest, F.lit(30))))
        return F.when(F.startswith(kind, F.lit("given:f")), female).when(F.startswith(kind, F.lit("given:m")), male).otherwise(raw)

    names = reduce(lambda a, s: F.when(F.endswith(kind, F.lit(s)), name(s)).otherwise(a), ("Cyrillic", "Greek"), name("Latin"))
    return (
        F.when(kind == "email", F.concat(_mapped(local, digest), F.lit("@"), host, F.lit(".example.com")))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), check, account))
        .when(kind == "ip", octets).when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(_mapped(canon, digest), F.lit(2))))
        .when(kind == "phone", F.concat(country, F.lit(":"), trunk, first, F.substr(_mapped(rest, digest), F.length(trunk) + 2))).otherwise(names)
    )


def _in_format(e: Column, symbols: Column, pattern: str) -> Column:
    """``e`` with its characters of ``pattern`` replaced one after the other by ``symbols``."""
    def put(c, i):
        before = F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), f"[^{pattern}]", ""))
        return F.when(c.rlike(f"[{pattern}]"), F.substr(symbols, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), put), "")


def _rendered(e: Column, tries: Column, key: str) -> Column:
    kind, ids = kind_of(e), identities(e)

    def of(i):
        return surrogate(i["kind"], i["canon"], F.coalesce(F.try_element_at(tries, F.concat_ws("|", i["kind"], i["canon"])), F.lit(0)), key)

    new = F.transform(ids, of)
    only, title = F.element_at(new, 1), F.split_part(e, F.lit(" "), F.lit(1))
    return (
        F.when(kind == "none", F.substr(e, F.lit(2))).when(kind == "name", F.concat_ws(" ", title, F.array_join(F.transform(new, lambda n: F.initcap(n)), " ")))
        .when(kind.isin("email", "ip"), only).when(kind == "iban", _in_format(e, only, "A-Z0-9")).otherwise(_in_format(e, _digits(only), "0-9"))
    )


def tries_without_collision(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, tries) such that no two identities of a kind share a surrogate and none is another's real value.

    Each round moves all but one of the identities that share a surrogate, and those that hit a real value, to their
    next try. Names grow by a letter a try and the other kinds have far more forms than identities, so few rounds do. Where a
    form is nearly used up, as local phones of seven digits are by millions of them, those still in conflict after MOST_TRIES
    rounds keep what they have: they share a surrogate.
    """
    at = staged(entities.withColumn("tries", F.lit(0)), "identities")
    for _ in range(MOST_TRIES):
        new = at.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.col("tries"), key))
        winner = new.groupBy("kind", "s").agg(F.min(F.struct("tries", "canon")).alias("winner"))
        real = entities.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
        judged = new.join(winner, ["kind", "s"]).join(real, ["kind", "s"], "left")
        lost = (F.col("winner.canon") != F.col("canon")) | F.col("real").isNotNull()
        judged = staged(judged.select("kind", "canon", (F.col("tries") + lost.cast("int")).alias("tries"), lost.alias("lost")), "identities")
        at = judged.select("kind", "canon", "tries")
        if judged.where("lost").isEmpty():
            break
    return at


def with_surrogates(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace e-mail addresses, IBANs, IPv4 addresses, cards, social security numbers, phones and titled names.

    A surrogate is a keyed function of what an occurrence refers to, not of its spelling: digits of a phone, lower-cased
    address, given and family name by themselves. So the same person or number gets the same surrogate everywhere, in the
    occurrence's own format: separators, country code, leading zero, number of digits, title, gender of the given name and script stay.
    Phones are those of ``_PHONES``; bare digits without '+', leading 0, brackets or the groups there could be any number and
    aren't taken for one. A number written with its country code and without, or with a '(0)' in it, counts as two.
    Cards and IBANs are those with valid check digits, and get such; others of their form stay. Social security numbers get an area that is never issued, addresses a reserved domain.
    Distinctness over the whole table is checked on the distinct identities, and the few that collide are tried anew.

    Texts are searched once and staged in pieces, the only regular expressions that run over all of them.

    Returns doc_id, n_entities, text, one row per row. A null text stays null. Other columns are ignored, repeated
    rows are replaced alike, and an empty table gives an empty one. Names are found behind a title only, of any length.
    """
    body = F.col(text)
    cut = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.split(body, ENTITY, -1).alias("between"), F.transform(F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0)), checked).alias("found")
    ), "cut")
    seen = cut.select(F.explode(F.array_distinct("found")).alias("e")).select(F.explode(identities(F.col("e"))).alias("i")).select("i.*")
    entities = staged(seen.distinct(), "entities")
    moved = tries_without_collision(entities, key).where("tries > 0")
    none = F.create_map().cast("map<string,int>")
    if moved.isEmpty():
        marked = cut.withColumn("tries", none)
    else:
        # Only documents that hold a moved identity have anything to look up.
        versions = cut.withColumn("version", F.xxhash64("between", "found"))
        held = F.array_distinct(F.flatten(F.transform("found", identities)))
        uses = versions.select("doc_id", "version", F.explode(held).alias("i")).select("doc_id", "version", "i.*")
        lookup = uses.join(moved, ["kind", "canon"]).select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), F.concat_ws("|", "kind", "canon").alias("k"), "tries").distinct()
        per_doc = lookup.groupBy("_id", "_v").agg(F.map_from_entries(F.collect_list(F.struct("k", "tries"))).alias("tries"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v"))
        marked = versions.join(per_doc, same, "left").select("doc_id", "between", "found", F.coalesce("tries", none).alias("tries"))
    new = F.transform("found", lambda e: _rendered(e, F.col("tries"), key))
    pieces = F.zip_with("between", new, lambda b, n: F.concat(b, F.coalesce(n, F.lit(""))))
    changed = F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.get("between", F.lit(0)))
    there = F.filter("found", lambda e: ~F.startswith(e, F.lit(_NOT)))
    return marked.select("doc_id", F.greatest(F.coalesce(F.size(there), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"), changed.alias("text"))


#: For the registered query only; real use brings a secret of its own.
QUERY_KEY = "query-key"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return with_surrogates(table(spark, folder, "documents"), QUERY_KEY)
