"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by one pattern over the whole text.  Each distinct entity gets a keyed replacement of its own kind:
a digit stands for a digit and a letter for a letter of its script, case and class (vowel or consonant); separators stay; an
address keeps its top-level domain, equal domains stay equal and different ones different; octets keep their width and range; a phone number keeps
its country code, a credential the prefix of its issuer, an IBAN its country; a card number and an IBAN keep right check
digits if they had them; a given name of the lists becomes another one of the same gender and script, in an order drawn from
the key; other given names and surnames are rewritten letter by letter, in their script, with hyphens, apostrophes and
particles as they were.  The key makes replacements
reproducible and secret; the caller brings it.

A person is found by a title, a listed given name or a phrase that introduces a name; from then on the surname and the given
name are looked for in the whole text by themselves, in their form and in capitals, so no later bare mention stays.  Given name
and surname are entities of their own, so that a surname alone and a full name corefer; as neither two given names nor two
surnames share a replacement, no two full names do.

Entities are compared in normal form (case and separators do not count), so mentions that differ only in form get one
replacement, written in each mention's form: coreference.  Replacements that meet each other or any real entity are drawn
anew until none do: distinctness.  The check joins written tables of distinct entities; nothing is collected.

Defined cases: null and empty texts pass through; a text without an entity is unchanged, byte for byte; repeated rows are
treated alike; a very long text has as many replacements as entities; an empty table gives an empty result; other columns
pass through, whatever their names.  More than MOST_DRAWS draws (a kind with too few forms) is an error, not a collision.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, fresh

MOST_DRAWS = 60

# given names by script and gender
NAMES = {
    ("latin", "f"): "Alice Amelia Anna Carla Charlotte Clara Elena Emily Emma Grace Helen Ines Julia Karen Laura Linda Lucia Maria Marta Olivia Paula Rosa Sarah Sofia".split(),
    ("latin", "m"): "Adam Anton Carlos Charles Daniel David Felix George Hans Henry Hugo Jack James John Jorge Karl Louis Lucas Martin Michael Oscar Paul Peter Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
TITLES = "Mrs Ms Miss Madam Frau Señora Madame Κυρία госпожа Mr Sir Herr Señor Monsieur Κύριος господин Dr Prof Professor Doctor Доктор".split()
INTRODUCTIONS = ("my name is", "My name is", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут")
PREFIX = r"^(akia|gh[pousr]_|sk-|xox[abpr]-)"

GAP = r"[^\p{L}\p{N}\n]{0,6}"
TITLE = "|".join(TITLES)
GIVEN = "|".join(n for names in NAMES.values() for n in names)
PARTICLES = "van von der den de di da del della la le du ten ter zu".split()
CAPITAL = r"(?:\p{Lu}['’]|Mc|Mac)?\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*"
SURNAME = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{CAPITAL}"
SHOUTED = "|".join(n.upper() for names in NAMES.values() for n in names)
LAST = r"(\p{L}+(?:[-'’]\p{L}+)*)$"  # a surname without its particles
# the kinds in the order in which they are tried
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,254}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "credential": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abpr]-[0-9A-Za-z-]{10,64})(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])",
    "hex": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "phone": rf"(?<![\p{{N}}+])\+\d{{1,3}}{GAP}\d{{2,4}}{GAP}\d{{3}}{GAP}\d{{4}}(?!\p{{N}})",
    "ipv4": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\p{N}|\.\p{N})",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<!\p{N})\d(?:[ -]?\d){12,18}(?!\p{N})",
    "local_phone": r"(?<![\p{N}-])(?:\(?\d{3}\)?[-. ])?\d{3}-\d{4}(?![\p{N}-])",
    "person": rf"(?<!\p{{L}})(?:(?:{TITLE})\.? (?:{CAPITAL} )?{SURNAME}|(?:{GIVEN}) {SURNAME}|(?:{SHOUTED}) \p{{Lu}}{{2,}}(?:[-'’]\p{{Lu}}{{2,}})*|(?<=(?:{'|'.join(INTRODUCTIONS)}) ){CAPITAL} {SURNAME})(?!\p{{L}})",
}
# what an entity of a kind can begin with: tested first, so most places in a text cost one look at one character
BEGINS = {
    "email": r"[\p{L}\p{N}._%+-]", "credential": "[Agsx]", "ipv6": "[0-9A-Fa-f]", "hex": "[0-9A-Fa-f]", "iban": "[A-Z]", "phone": r"\+", "ipv4": r"\d", "ssn": r"\d", "card": r"\d",
    "local_phone": r"[(\d]", "person": r"[\p{Lu}г]",
}
ANY = "|".join(f"(?={BEGINS[k]}){p}" for k, p in KINDS.items())
DIGITS_ONLY = ("phone", "card", "ssn", "local_phone")


def kind_of(raw: Column) -> Column:
    out = F.lit("person")
    for kind in reversed(list(KINDS)):
        out = F.when(raw.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def normal_form(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    code = F.regexp_extract(raw, r"^\+(\d{1,3})", 1)
    plain = F.when(F.length(F.lower(raw)) == F.length(raw), F.lower(raw)).otherwise(raw)
    return (
        F.when(kind == "phone", F.concat(code, F.lit(":"), F.substring(digits, F.length(code) + 1, F.length(digits))))
        .when(kind.isin(*DIGITS_ONLY), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(raw, " ", "")))
        .when(kind == "person", F.lower(F.regexp_extract(raw, LAST, 1)))
        .otherwise(plain)
    )


def stream(*parts: Column) -> Column:
    """256 keyed bytes as hexadecimal text."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *parts, F.lit(str(i))), 512) for i in range(4)])


def byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, (F.pmod(i, F.lit(256)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


# letters that stand for each other
CLASSES = [
    (r"^[0-9]$", "0123456789"), (r"^[aeiou]$", "aeiou"), (r"^[a-z]$", "bcdfghjklmnpqrstvwxyz"), (r"^[а-яё]$", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"^[α-ωά-ώ]$", "αβγδεζηθικλμνξοπρστυφχψω"), (r"^[à-öø-ÿ]$", "àáâèéêëìíîïòóôöùúûü"),
    (r"^[AEIOU]$", "AEIOU"), (r"^[A-Z]$", "BCDFGHJKLMNPQRSTVWXYZ"), (r"^\p{IsHan}$", "安白陈大方高海江林明"),
]


def rewrite(text: Column, hexes: Column, classes=CLASSES) -> Column:
    """Each character replaced by one of its class, drawn from the stream."""

    def draw(c, i):
        out = c
        for pattern, letters in reversed(classes):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), (byte(hexes, i) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), draw), "")


HEXES = [(r"^[0-9]$", "0123456789"), (r"^[a-f]$", "abcdef")]


def luhn(digits: Column) -> Column:
    """Sum of the check algorithm over digits, the last one not doubled."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def mod_97(account: Column) -> Column:
    """Remainder by 97 of an account number in lower case whose first four characters are put last; letters count from 10."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
    chars = F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def surrogate(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    hexes = stream(F.lit(key), kind, norm, draw.cast("string"))
    longer = F.repeat(F.lit("x"), (draw / 8).cast("int"))  # short ones have too few forms
    host, top = F.regexp_extract(norm, r"^(.*)\.", 1), F.regexp_extract(norm, r"\.[^.]*$", 0)
    domain = F.concat(rewrite(F.concat(host, longer), hexes), top)
    email = F.concat(rewrite(F.concat(F.substring_index(norm, "@", 1), longer), hexes), F.lit("@"), F.substring_index(norm, "@", -1))  # its domain is an entity of its own
    octet = lambda o, i: F.when(F.length(o) == 1, byte(hexes, i) % 9 + 1).when(F.length(o) == 2, byte(hexes, i) % 90 + 10).otherwise(byte(hexes, i) % 156 + 100).cast("string")
    ipv4 = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    code = F.substring_index(norm, ":", 1)
    phone = F.concat(code, F.lit(":"), rewrite(F.substring_index(norm, ":", -1), hexes))
    digits = rewrite(norm, hexes)
    stem = F.substring(digits, F.lit(1), F.length(digits) - 1)
    name = rewrite(F.substring(F.repeat(norm, 3), F.lit(1), F.greatest(F.length(norm), F.lit(5))), hexes)  # short names have too few forms
    check = F.pmod(F.lit(10) - luhn(F.concat(stem, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(luhn(norm) % 10 == 0, F.concat(stem, check)).otherwise(digits)
    prefix = F.regexp_extract(norm, PREFIX, 1)
    credential = F.concat(prefix, F.substring(digits, F.length(prefix) + 1, F.length(digits)))
    country, account = F.substring(norm, 1, 2), F.substring(digits, F.lit(5), F.length(digits))
    right = F.lpad((F.lit(98) - mod_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(mod_97(norm) == 1, right).otherwise(F.substring(digits, 3, 2)), account)
    return (
        F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "credential", credential).when(kind == "iban", iban).when(kind == "ipv4", ipv4).when(kind == "phone", phone).when(kind == "card", card).when(kind == "given", name)
        .when(kind.isin("hex", "ipv6"), rewrite(norm, hexes, HEXES)).otherwise(digits)
    )


def given_name(raw: Column) -> Column:
    title = F.regexp_extract(raw, rf"^(?:{TITLE})\.? ", 0)
    return F.regexp_extract(F.substring(raw, F.length(title) + 1, F.length(raw)), rf"^({CAPITAL}|\p{{Lu}}{{2,}}(?:[-'’]\p{{Lu}}{{2,}})*) ", 1)


LISTED = [n for names in NAMES.values() for n in names]


def found_in(docs: DataFrame) -> DataFrame:
    """key, pattern, at, raw, kind, norm, given of every mention in the texts of docs(text); equal texts have one key.

    The pattern is the text's own: with the names of its persons by themselves, if it has any.  given is the normal form of a
    given name that is on no list; kind given_name is a given name by itself.
    """
    first = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text", F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)).alias("first"))
    persons = F.filter("first", lambda r: r.rlike(r"^[\p{L}\p{M}. '’-]+$") & ~r.rlike(PREFIX))
    quiet = lambda n: F.when(n == F.upper(n), F.initcap(n)).otherwise(n)
    surnames = F.array_distinct(F.transform(persons, lambda r: quiet(F.regexp_extract(r, LAST, 1))))
    givens = F.array_distinct(F.filter(F.transform(persons, lambda r: quiet(given_name(r))), lambda g: g != ""))
    names = first.select("*", surnames.alias("surnames"), givens.alias("givens"))
    bare = F.array_distinct(F.concat("surnames", "givens", F.transform("surnames", F.upper), F.transform("givens", F.upper)))
    bare = F.reverse(F.array_sort(bare))  # of two names that begin alike the longer one is tried first
    pattern = F.when(F.size("surnames") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(bare, "|"), F.lit(r")(?!\p{L})")))
    names = names.withColumn("pattern", pattern)
    raws = F.when(F.col("pattern").isNull(), F.col("first")).otherwise(F.regexp_extract_all("text", F.concat(F.lit("("), "pattern", F.lit(")")), F.lit(1)))
    out = names.select("key", "pattern", "surnames", "givens", F.posexplode(raws).alias("at", "raw"))
    same = lambda names: F.exists(names, lambda n: (n == F.col("raw")) | (F.upper(n) == F.col("raw")))
    alone = F.col("pattern").isNotNull() & same("givens") & ~same("surnames")
    out = out.withColumn("kind", F.when(alone, "given_name").otherwise(kind_of(F.col("raw"))))
    given = F.when(F.col("kind") == "given_name", F.col("raw")).when(F.col("kind") == "person", given_name(F.col("raw"))).otherwise("")
    given = F.when((given != "") & ~F.lower(given).isin([n.lower() for n in LISTED]), F.lower(given))
    return out.select("key", "pattern", "at", "raw", "kind", normal_form(F.col("kind"), F.col("raw")).alias("norm"), given.alias("given"))


def distinct_surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, norm, surrogate): no two entities of a kind share one, and none is an entity itself or a listed given name.

    A mail domain is an entity too.  Addresses are kept apart within their domain, and domains from each other, so whole addresses are.
    """
    given = entities.where("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("norm"))
    domains = entities.where("kind = 'email'").select(F.lit("domain").alias("kind"), F.substring_index("norm", "@", -1).alias("norm"))
    entities = scratch.save(entities.where("kind <> 'given_name'").select("kind", "norm").union(given).union(domains).distinct(), "entities")
    listed = entities.sparkSession.createDataFrame([("given", n.lower()) for n in LISTED], "kind string, norm string")
    taken = entities.union(listed)
    drawn = entities.withColumn("draw", F.lit(0))
    for k in range(MOST_DRAWS):
        drawn = scratch.save(drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("draw"), key)), f"draw{k}")
        shared = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "norm")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        late = drawn.join(shared, ["kind", "surrogate"]).where(F.struct("draw", "norm") != F.col("first")).select("kind", "norm")
        real = drawn.join(taken.withColumnRenamed("norm", "surrogate"), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        again = scratch.save(late.union(real).distinct(), f"again{k}")
        if not again.limit(1).count():
            return with_domains(drawn.select("kind", "norm", "surrogate"))
        again = again.withColumn("more", F.lit(1))
        drawn = drawn.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw"))
    raise RuntimeError(f"some kind has too few forms to keep its entities apart in {MOST_DRAWS} draws")


MOST_SENT = 100_000  # domains that are sent to all executors; more are joined by a shuffle


def with_domains(chosen: DataFrame) -> DataFrame:
    """chosen(kind, norm, surrogate) with each address's domain replaced by that domain's surrogate; domains themselves go."""
    hosts = chosen.where("kind = 'domain'").select(F.col("norm").alias("host"), F.col("surrogate").alias("new_host"))
    emails = chosen.where("kind = 'email'").withColumn("host", F.substring_index("norm", "@", -1)).join(F.broadcast(hosts) if hosts.count() <= MOST_SENT else hosts, "host")
    emails = emails.select("kind", "norm", F.concat(F.substring_index("surrogate", "@", 1), F.lit("@"), "new_host").alias("surrogate"))
    return chosen.where("kind not in ('domain', 'email')").unionByName(emails)


def exchanged(key: str) -> dict[str, str]:
    """Each listed given name's replacement, in lower case: the next one of its gender and script in an order drawn from the key."""
    out = {}
    for names in NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out |= {n.lower(): m.lower() for n, m in zip(order, [*order[1:], order[0]], strict=True)}
    return out


def written(kind: Column, raw: Column, new: Column, new_given: Column, key: str) -> Column:
    """The surrogate in the form of the mention: its separators, its capitals, its title."""
    chars = F.split(raw, "")

    def in_turn(shown: Column, pattern: str) -> Column:
        """raw with its characters of the pattern replaced by those of `shown` in turn, in raw's case."""
        at = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: c.rlike(pattern)))
        here = lambda c, i: F.when(c == F.upper(c), F.upper(F.substring(shown, at(i), F.lit(1)))).otherwise(F.substring(shown, at(i), F.lit(1)))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), here(c, i)).otherwise(c)), "")

    def cased(old: Column, shown: Column) -> Column:
        """shown in the case of old; what is longer goes on in the case of old's last letter."""
        low = F.substring(old, F.length(old), F.lit(1)) == F.lower(F.substring(old, F.length(old), F.lit(1)))
        letter = lambda c, i: F.when(c == F.lower(c), F.substring(shown, i + 1, F.lit(1))).otherwise(F.upper(F.substring(shown, i + 1, F.lit(1))))
        rest = F.substring(shown, F.length(old) + 1, F.length(shown))
        return F.concat(F.array_join(F.transform(F.split(old, ""), letter), ""), F.when(low, rest).otherwise(F.upper(rest)))

    names = F.create_map(*[F.lit(x) for pair in exchanged(key).items() for x in pair])
    called = lambda g: cased(g, F.coalesce(F.element_at(names, F.lower(g)), new_given))
    last, given = F.regexp_extract(raw, LAST, 1), given_name(raw)
    particles = F.regexp_extract(raw, rf"(?:^| )((?:(?:{'|'.join(PARTICLES)}) )+)[^ ]+$", 1)
    title = F.regexp_extract(raw, rf"^(?:{TITLE})\.? ", 0)
    person = F.concat(title, F.when(given == "", F.lit("")).otherwise(F.concat(called(given), F.lit(" "))), particles, cased(last, new))
    return (
        F.when(kind.isin(*DIGITS_ONLY), in_turn(F.regexp_replace(new, r"\D", ""), r"^\d$")).when(kind == "iban", in_turn(new, r"^[\p{L}\p{N}]$"))
        .when(kind == "person", person).when(kind == "given_name", called(raw)).otherwise(cased(raw, new))
    )


def replace_entities(docs: DataFrame, key: str, counts_as: str | None = None) -> DataFrame:
    """docs with entities in text replaced; with counts_as also a struct of that name: n_found, kinds."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    mentions = scratch.save(found_in(docs.select("text")), "mentions")
    chosen = scratch.save(distinct_surrogates(mentions, key, scratch), "surrogates")
    given = chosen.where("kind = 'given'").select(F.col("norm").alias("given"), F.col("surrogate").alias("new_given"))
    new = mentions.join(chosen, ["kind", "norm"], "left").join(given, "given", "left")
    # equal texts have equal mentions: one array a text
    new = new.groupBy("key", "at").agg(F.first(F.struct("kind", "raw", "surrogate", "new_given", "pattern")).alias("m"))
    shown = written(F.col("m.kind"), F.col("m.raw"), F.col("m.surrogate"), F.col("m.new_given"), key)
    new = new.select("key", "m.pattern", F.struct("at", shown.alias("w"), F.when(F.col("m.kind") == "given_name", "person").otherwise(F.col("m.kind")).alias("kind")).alias("m"))
    per_text = new.groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("new"), F.first("pattern").alias("pattern"))
    own, of, found, pattern = fresh(docs, "own", "of", "found", "pattern")
    per_text = scratch.save(per_text.toDF(of, found, pattern), "per_text")

    hit = docs.withColumn(own, F.unhex(F.md5(F.col("text").cast("binary")))).join(per_text.hint("merge"), F.col(own) == F.col(of), "left")
    gaps = F.split("text", F.coalesce(pattern, F.lit(ANY)), F.lit(-1))
    woven = F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.element_at(F.col(found)["w"], i), g))), "")
    some, kind = F.col(found).isNotNull(), F.col(found)["kind"]
    n, kinds = F.when(some, F.size(found)).otherwise(0), F.when(some, F.array_join(F.array_sort(F.array_distinct(kind)), ",")).otherwise("")
    columns = [F.when(some, woven).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return hit.select(*columns, *([F.struct(n.cast("long").alias("n_found"), kinds.alias("kinds")).alias(counts_as)] if counts_as else []))


def op2_surrogates(spark, sf_dir: str) -> DataFrame:
    """The key is the session's spark.gneiss.surrogates.key; where none is set, one is drawn for this run and not kept."""
    key = spark.conf.get("spark.gneiss.surrogates.key", None) or secrets.token_hex(32)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key, counts_as="pii").select("doc_id", "pii.n_found", "pii.kinds", "text")
