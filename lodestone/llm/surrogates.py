r"""Surrogates for personal data, with Spark's own functions only.

Entities are found by pattern and replaced by keyed surrogates: SHA-256 of a key, the entity's kind, its
canonical form and an attempt number picks the digits, letters or names of something of the same kind
and format. Spellings of one value (a phone number with other punctuation, an address in other case)
share a canonical form and so a surrogate, everywhere in the corpus. Names and addresses are made of parts with
surrogates of their own - a family name, given names by gender, a mailbox, a domain - so that `Mr. John Smith` and
`Mr. Smith` keep one family name, and the mailboxes of one domain stay together. Names keep their title, their number of
words and their script (Latin, Cyrillic or Greek; others become Latin); a mailbox keeps its punctuation, and from eight letters and digits on each of
them its sort; domains keep their labels, below the reserved `.example`. A secret runs to its closing quote or, without
quotes, to a blank, quote, bracket, comma or semicolon; a name takes all capitalised words and initials that follow. Distinct values stay distinct: surrogates
that two values share, or that are some value of the corpus, are drawn again until none is left. That holds for each kind
of part, and so for what is made of them.

A name that a text introduces with a title is replaced in all of that text: each capitalised word elsewhere in it that is one of
the name's parts (`John Smith`, `Smith's`, `Smith-like`) gets that part's surrogate, a family name's where it is both. A genitive `'s` stays
behind the surrogate. The country in front of a phone number stays, where a sign sets it apart; addresses of private ranges
stay in their range, and all others become addresses of the reserved block 240.0.0.0/4.

Only distinct entities, and the texts that have any, are shuffled.

Defined results: a null text stays null and an empty one empty; texts without entities come out as they are; rows
repeat as they come, each with the kinds of its own text, and equal values get equal surrogates in all of them; doc_id may be null or repeat; extra columns pass through, but for an input
column `kinds` or `n_entities`, whose place the result takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MALE = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|Господин|Г-н|Κύριος"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Señora|Sra\.|Госпожа|Г-жа|Κυρία"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: A word that may be part of a name, without a genitive.
WORD = r"(?<![\p{L}\p{N}_])\p{Lu}\p{L}+(?:['’-]\p{L}{2,})*(?![\p{L}\p{N}_])"
JOINS, GENITIVE = "['’-]", r"['’][sS]?$"
FULL_NAME = rf"{NAME}(?: (?!(?:{MALE}|{FEMALE}) \p{{Lu}})(?:\p{{Lu}}\. )*{NAME})*+"
#: A secret's characters where no quotes end it; full stops and the like behind it are the sentence's.
OPEN = r"""\s"'`<>()\[\]{},;"""
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "secret": rf"""(?i:\b(?:password|passwd|pwd|token|secret|api_?key))\s{{0,3}}[=:]\s{{0,3}}(?:"[^"\r\n]{{8,}}+"|'[^'\r\n]{{8,}}+'(?![A-Za-z0-9])|["']?[^{OPEN}]{{7,}}[^{OPEN}.:!?]["']?)""",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "card": r"(?<![\d.\-])\d{4}(?:[ \-]?\d{4}){3}(?![\d\-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "man": rf"(?<!\p{{L}})(?:{MALE}) {FULL_NAME}",
    "woman": rf"(?<!\p{{L}})(?:{FEMALE}) {FULL_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with any entity has: a cheap look before the patterns.
HINT = rf"[0-9@]|[=:]|{MALE}|{FEMALE}"
#: Given names by kind and script, and syllables of family names by script.
GIVEN = {
    ("man", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul"],
    ("woman", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("man", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("man", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ευάγγελος", "Ζήσης", "Ηλίας", "Θωμάς", "Ιάσονας", "Κώστας", "Λάμπρος", "Μιχάλης", "Νίκος", "Ορέστης", "Πέτρος", "Στέφανος"],
    ("woman", "greek"): ["Αγγελική", "Βαρβάρα", "Γεωργία", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Καλλιόπη", "Λυδία", "Μαρία", "Νεφέλη", "Ουρανία", "Πηνελόπη", "Σοφία"],
    ("woman", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"], "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"], "greek": ["βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "λα", "ζο"]}
HONORIFIC = rf"^(?:{MALE}|{FEMALE}) "
SECRET_HEAD, SECRET_TAIL = r"""(?s)^(.*?[=:]\s*["']?)""", r"""(["']?)$"""


def kind_of(value: Column) -> Column:
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("secret"))


MADE = ("man", "woman", "email")  # kinds whose values are made of parts
GIVEN_KINDS = ("given man", "given woman")  # parts
NAME_PARTS = ("family", *GIVEN_KINDS)  # in the order in which a word alone is read
SUBSCRIBER = 10  # digits of a phone number behind the country's
COUNTRY = r"^\+(\d{1,3})[ .\-(]"  # a country that a sign sets apart
WIDEN = 6  # draws of one length


def canonical(kind: Column, value: Column) -> Column:
    """One spelling of a value."""
    digits = F.regexp_replace(value, r"\D", "")
    own = F.substr(digits, F.char_length(F.regexp_extract(value, COUNTRY, 1)) + 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(value, HONORIFIC, ""), GENITIVE, ""))
    core = F.regexp_replace(F.regexp_replace(value, r"""(?s)^.*?[=:]\s*["']?""", ""), SECRET_TAIL, "")
    return F.when(kind == "phone", F.right(own, F.lit(SUBSCRIBER))).when(kind.isin("card", "ssn"), digits).when(kind == "email", F.lower(value)).when(kind.isin("man", "woman"), name).when(kind == "secret", core).otherwise(value)


def _hex(key: str, kind: Column, value: Column, attempt: Column, n: int = 4) -> Column:
    """256 n bits as hex digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(i))), 256) for i in range(n)])


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th byte (from 0) of hex digits, as a number."""
    at = F.lit(2 * i + 1) if isinstance(i, int) else i * 2 + 1
    return F.conv(h.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _same_shape(value: Column, h: Column) -> Column:
    """Each digit by a digit and each letter by one of its case; the hash wraps round after 128 signs.

    Letters of other scripts become small Latin ones. A value with too few letters and digits to draw from is all hex digits.
    """
    upper, lower, digit, low_hex = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    is_hex = value.rlike("^[0-9a-f]+$") | (F.char_length(F.regexp_replace(value, r"[^A-Za-z0-9]", "")) < 8)

    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i % 128)
        pick = lambda s: F.lit(s).substr((b % len(s) + 1).cast("int"), F.lit(1))
        return F.when(is_hex, pick(low_hex)).when(c.rlike("[0-9]"), pick(digit)).when(c.rlike("[A-Z]"), pick(upper)).when(c.rlike(r"[a-z\p{L}]"), pick(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits(h: Column, n: int) -> Column:
    return F.concat(*[(_byte(h, i) % 10).cast("string") for i in range(n)])


def luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the card check."""
    at = F.sequence(F.lit(1), F.char_length(body))

    def part(i: Column) -> Column:
        d = body.substr(i, F.lit(1)).cast("int") * F.when((F.char_length(body) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(10 - F.aggregate(F.transform(at, part), F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical form of a value's surrogate."""
    h = _hex(key, kind, value, attempt)
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    name = F.lit(None).cast("string")
    for (k, s), given in GIVEN.items():
        syllable = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        # a further syllable for each draw: names never run out
        more = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(syllable, _byte(h, i % 128) % 16 + 1)), "")  # noqa: B023, E731
        first = F.element_at(F.array(*[F.lit(x) for x in given]), _byte(h, 0) % 16 + 1)
        name = F.when((kind == f"given {k}") & (script == s), F.when(attempt > 0, F.concat(first, more(attempt + 1))).otherwise(first)).when((kind == "family") & (script == s), F.initcap(more(attempt + 4))).otherwise(name)
    octet = lambda i: _byte(h, i).cast("string")
    block = F.when(value.rlike(r"^(?:10|127)\."), F.concat_ws(".", F.substring_index(value, ".", 1), octet(1)))
    block = block.when(value.rlike(r"^192\.168\."), F.lit("192.168")).when(value.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.concat(F.lit("172."), (_byte(h, 1) % 16 + 16).cast("string")))
    ip = F.concat_ws(".", block.otherwise(F.concat_ws(".", (_byte(h, 0) % 15 + 240).cast("string"), octet(1))), octet(2), octet(3))
    card = F.concat(F.substring(value, 1, 1), _digits(h, 14))
    phone = F.substring(F.concat((_byte(h, 0) % 8 + 2).cast("string"), F.substring(_digits(h, 16), 2, 15)), F.lit(1), F.char_length(value))
    # where the values of a kind outgrow its surrogates, later draws are longer; names grow by syllables instead
    wide = F.when(kind.isin("mailbox", "domain"), attempt - 2).otherwise(attempt - WIDEN)
    longer = F.when((wide >= 0) & ~kind.isin("family", *GIVEN_KINDS), F.concat(F.lit("-"), F.substring(h, F.lit(129), wide + 4))).otherwise("")
    drawn = (
        F.when(kind.isin("mailbox", "domain"), _same_shape(value, h))
        .when(kind == "key_id", F.concat(F.substring(value, 1, 4), _same_shape(F.regexp_replace(F.substring(value, 5, 16), ".", "A"), h)))
        .when(kind == "card", F.concat(card, luhn_digit(card)))
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("9"), _digits(h, 8)))
        .when(kind.isin("family", *GIVEN_KINDS), name)
        .otherwise(_same_shape(value, h))
    )
    return F.concat(drawn, longer)


def formatted(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate in the punctuation, or behind the title or label, of the value that it replaces."""
    # a country's digits before a subscriber's stay; what a longer surrogate has left follows
    count = F.char_length(F.regexp_replace(value, r"\D", ""))
    before = F.when(kind == "phone", F.greatest(count - SUBSCRIBER, F.char_length(F.regexp_extract(value, COUNTRY, 1)))).otherwise(0)
    start = F.struct(F.lit("").alias("out"), (1 - before).alias("at"))
    put = lambda a, c: F.when(a["at"] < 1, c).otherwise(new.substr(a["at"], F.lit(1)))
    step = lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["out"], put(a, c)).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    fill = F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["out"], F.substring(new, a["at"], F.char_length(new))))
    labelled = F.concat(F.regexp_extract(value, SECRET_HEAD, 1), new, F.regexp_extract(value, SECRET_TAIL, 1))
    return F.when(kind.isin("phone", "card", "ssn"), fill).when(kind.isin("man", "woman"), F.concat(F.regexp_extract(value, HONORIFIC, 0), new, F.regexp_extract(value, GENITIVE, 0))).when(kind == "secret", labelled).otherwise(new)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new for distinct (kind, canon), without clashes; each round only draws again what clashed.

    Kinds are those of parts. From round WIDEN on (mailboxes, domains and names: earlier) surrogates get longer each time, so that the rounds end however many values a kind has.
    """
    done, pending, attempt = [], entities, 0
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        drawn = stored(pending.repartition(tasks, "kind", "canon").select("kind", "canon", surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)).alias("new")), "pii-draw")
        real = entities.select(F.col("kind").alias("of"), F.lower("canon").alias("real"))  # in any case
        fresh = drawn.join(real, (F.col("kind") == F.col("of")) & (F.lower("new") == F.col("real")), "left_anti")
        for other in done:
            fresh = fresh.join(other.select("kind", "new"), ["kind", "new"], "left_anti")
        good = stored(fresh.groupBy("kind", "new").agg(F.min("canon").alias("canon")), "pii-good")
        done.append(good)
        pending = drawn.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon")
        attempt += 1
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)


def parts_of(kind: Column, canon: Column) -> Column:
    """The parts that a value is made of, in order: (kind, canon). Most values are a part of their own kind."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    words = F.split(canon, " ")
    role = lambda i: F.when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given "), kind))
    name = F.transform(words, lambda w, i: part(role(i), w))
    mail = F.array(part(F.lit("mailbox"), F.substring_index(canon, "@", 1)), part(F.lit("domain"), F.substring_index(canon, "@", -1)))
    return F.when(kind.isin("man", "woman"), name).when(kind == "email", mail).otherwise(F.array(part(kind, canon)))


def surrogates_of(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new for distinct (kind, canon): surrogates of their parts, put together."""
    own = stored(entities.select("kind", "canon", F.posexplode(parts_of(F.col("kind"), F.col("canon"))).alias("at", "part")).select("kind", "canon", "at", F.col("part.kind").alias("part_kind"), F.col("part.canon").alias("part_canon")), "pii-parts")
    distinct = stored(own.select(F.col("part_kind").alias("kind"), F.col("part_canon").alias("canon")).distinct(), "pii-distinct")
    table = assign(distinct, key).select(F.col("kind").alias("part_kind"), F.col("canon").alias("part_canon"), F.col("new").alias("part"))
    whole = own.join(table, ["part_kind", "part_canon"])  # a domain of very many mailboxes is split as a skewed join
    single, several = whole.where(~F.col("kind").isin(*MADE)), whole.where(F.col("kind").isin(*MADE))
    between = F.when(F.col("kind") == "email", "@").otherwise(" ")
    put = several.groupBy("kind", "canon").agg(F.array_sort(F.collect_list(F.struct("at", "part")))["part"].alias("parts"))  # the words of one name
    joined = F.concat(F.element_at("parts", 1), F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.lit(""), lambda a, p: F.concat(a, between, p)))
    return single.select("kind", "canon", F.col("part").alias("new")).unionByName(put.select("kind", "canon", F.when(F.col("kind") == "email", F.concat(joined, F.lit(".example"))).otherwise(joined).alias("new")))


def name_parts(kind: Column, canon: Column, new: Column) -> Column:
    """(of, word, new) of each word of a name, which has as many words as its surrogate; empty for other kinds. Initials are left out."""
    pairs = F.zip_with(parts_of(kind, canon), F.split(new, " "), lambda p, n: F.struct(p["kind"].alias("of"), p["canon"].alias("word"), n.alias("new")))
    none = F.array().cast("array<struct<of:string,word:string,new:string>>")
    return F.when(kind.isin("man", "woman"), F.filter(pairs, lambda p: ~F.endswith(p["word"], F.lit(".")))).otherwise(none)


def replace(docs: DataFrame, key: str = "lodestone") -> DataFrame:
    """The rows of docs with entities in `text` replaced; adds n_entities and kinds (distinct, sorted, comma-joined)."""
    cols = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    text = F.col("text").cast("string")
    values = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*cols, F.coalesce(values, F.array().cast("array<string>")).alias("_values"))
    # a row's key: equal rows share their replacements, and rows without an id have each their own
    key_of_row = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256)
    flagged = stored(rows.where(F.size("_values") > 0).withColumn("_row", key_of_row), "pii-flagged")
    found = flagged.select("_row", F.explode(F.array_distinct("_values")).alias("value")).distinct().withColumn("kind", kind_of(F.col("value")))
    found = stored(found.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "pii-found")
    entities = stored(found.select("kind", "canon").distinct(), "pii-entities")
    table = surrogates_of(entities, key)
    new = found.join(table, ["kind", "canon"]).select("_row", "kind", F.struct("value", formatted(F.col("kind"), F.col("value"), F.col("new")).alias("new")).alias("pair"), name_parts(F.col("kind"), F.col("canon"), F.col("new")).alias("parts"))
    part = lambda of: F.map_from_entries(F.array_distinct(F.flatten(F.collect_set(F.transform(F.filter("parts", lambda p: p["of"] == of), lambda p: F.struct(p["word"].alias("word"), p["new"].alias("new")))))))
    by_row = new.groupBy("_row").agg(F.map_from_entries(F.collect_set("pair")).alias("_map"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), *[part(of).alias(f"_{i}") for i, of in enumerate(NAME_PARTS)])
    of_word = lambda w: F.coalesce(*[F.element_at(F.col(f"_{i}"), F.lower(w)) for i in range(len(NAME_PARTS))])
    one = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.coalesce(of_word(w), w)).otherwise(w)
    within = lambda w: F.array_join(F.zip_with(F.split(w, JOINS, -1), F.regexp_extract_all(w, F.lit(f"({JOINS})"), F.lit(1)), lambda p, j: F.concat(one(p), F.coalesce(j, F.lit("")))), "")
    told = lambda w: F.coalesce(of_word(w), F.when(w.rlike(JOINS), within(w)), w)
    later = lambda p: F.array_join(F.zip_with(F.split(p, WORD, -1), F.regexp_extract_all(p, F.lit(f"({WORD})"), F.lit(1)), lambda q, w: F.concat(q, F.coalesce(told(w), F.lit("")))), "")
    named = F.size("_0") > 0  # each name has a family name
    pieces = F.split(text, ANY, -1)
    pieces = F.when(named, F.transform(pieces, later)).otherwise(pieces)
    filled = F.array_join(F.zip_with(pieces, F.col("_values"), lambda p, v: F.concat(p, F.coalesce(F.element_at(F.col("_map"), v), F.lit("")))), "")
    others = [c for c in cols if c != "text"]
    changed = flagged.join(by_row, "_row").select(*others, filled.alias("text"), F.size("_values").cast("long").alias("n_entities"), "kinds")
    plain = rows.where(F.size("_values") == 0).select(*others, text.alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return plain.unionByName(changed).select(*cols, "n_entities", "kinds")
