"""Surrogates for personal data; DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, phone numbers, payment cards (issuer prefix
and check digit must be right, other long numbers stay), social security numbers, secrets
(keys and tokens) and names after a title; other mentions of such a name in the same text,
as full name or surname, are mentions of the same entity. Every distinct entity gets one surrogate made
from a keyed hash, so mentions of one entity keep referring to one entity, across
documents and spellings. Surrogates keep type and format: digits stay digits, letters stay
letters of their script and case (Latin ones where the script has no alphabet here),
cards keep issuer and valid check digit, given names keep the gender of their title. No two entities share a surrogate and none is an entity
of the corpus: clashes are tried again with the next hash until there are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.llm.common import fresh, written

# Titles by gender, and the makings of names by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
}
NAME_PARTS = {
    "latin": ("bar", "cel", "dor", "fen", "gal", "hel", "jun", "kor", "lam", "mel", "nor", "pas", "ril", "sam", "tor", "val"),
    "cyrillic": ("бар", "вел", "гор", "дан", "жел", "зар", "кор", "лад", "мил", "нор", "пав", "рос", "сав", "тар", "фед", "яр"),
    "greek": ("αλκ", "βασ", "γερ", "δημ", "ελπ", "ζην", "ηλι", "θαλ", "καλ", "λεω", "μελ", "νικ", "παλ", "ροδ", "σταθ", "φιλ"),
}
ENDINGS = {
    ("latin", "f"): ("a", "ina", "ella", "ia"),
    ("latin", "m"): ("o", "us", "an", "ert"),
    ("latin", "s"): ("son", "er", "ez", "ard"),
    ("cyrillic", "f"): ("а", "ина", "ия", "ела"),
    ("cyrillic", "m"): ("ий", "ор", "ан", "ей"),
    ("cyrillic", "s"): ("енко", "ук", "ых", "ян"),
    ("greek", "f"): ("α", "ινα", "ια", "ελα"),
    ("greek", "m"): ("ος", "ης", "ων", "ας"),
    ("greek", "s"): ("ακης", "ιδης", "ου", "εας"),
}

_TITLE = "|".join(t for group in TITLES.values() for t in group)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,8}\.\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
SECRET = (
    r"(?<=(?i:token|secret|password|passwd|key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{16,}"
    r"|(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
)
NAME = rf"(?<![\p{{L}}\p{{N}}])(?i:{_TITLE})\.? (?:\p{{Lu}}\p{{Ll}}++|\p{{Lu}}{{2,}}+)(?: (?:\p{{Lu}}\p{{Ll}}++|\p{{Lu}}{{2,}}+)(?!\p{{L}}))?"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, CARD, PHONE, SSN, IP, NAME))
# What a text must hold to be looked at closely.
GATE = rf"[0-9@]|AKIA|(?<![\p{{L}}\p{{N}}])(?i:{_TITLE})\.? \p{{Lu}}|(?i:token|secret|password|passwd|key)[\"']?\s{{0,2}}[:=]"
CARD_PREFIX = "^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|5|4[4-9]))"

ROUNDS = 24


def found(text: Column) -> Column:
    """All matches in a text that may be entities, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"[^0-9]", "")


def _luhn(d: Column) -> Column:
    """The check sum of a string of digits, modulo ten; zero is valid."""

    def add(total, i):
        digit = F.substring(F.reverse(d), i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10


def kind(e: Column) -> Column:
    """The type of a match; null for long numbers that are no cards."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(f"^(?i:{_TITLE})\\.? "), "name")
        .when(e.rlike(f"^{SSN}$"), "ssn")
        .when(e.rlike(f"^{IP}$"), "ip")
        .when(e.rlike(f"^(?:{CARD})$"), F.when(_digits(e).rlike(CARD_PREFIX) & (_luhn(_digits(e)) == 0), "card"))
        .when(e.rlike(r"^[+(\d][\d ().-]+$"), "phone")
        .otherwise("secret")
    )


def entities(e: Column) -> Column:
    """The entities of a match as ``kind|canonical form``: one, or two for a full name."""
    k = kind(e)
    words = F.split(F.regexp_replace(e, f"^(?i:{_TITLE})\\.? ", ""), " ")
    female = e.rlike(f"^(?i:{'|'.join(TITLES['f'])})\\.? ")
    given = F.concat(F.when(female, "given_f|").otherwise("given_m|"), F.initcap(F.get(words, F.lit(0))))
    last = F.concat(F.lit("surname|"), F.initcap(F.element_at(words, -1)))
    return (
        F.when(k.isNull(), F.array().cast("array<string>"))
        .when((k == "name") & (F.size(words) > 1), F.array(given, last))
        .when(k == "name", F.array(last))
        .when(k.isin("card", "phone", "ssn"), F.array(F.concat(k, F.lit("|"), _digits(e))))
        .when(k == "email", F.array(F.concat(k, F.lit("|"), F.lower(e))))
        .when((k == "secret") & e.rlike("^[0-9A-F]+$"), F.array(F.concat(k, F.lit("|"), F.lower(e))))
        .otherwise(F.array(F.concat(k, F.lit("|"), e)))
    )


# --- making surrogates -----------------------------------------------------------------


def _byte(h: Column, i) -> Column:
    """Byte i (from 0, again from the start after 64) of a string of 128 hexadecimal digits."""
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _alike(s: Column, h: Column) -> Column:
    """Every digit and letter replaced by one of its script and case, those of scripts
    without an alphabet here by Latin letters and ASCII digits; the rest kept."""

    def one(i):
        c, n = F.substring(s, i, F.lit(1)), _byte(h, i)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"[\p{IsLatin}&&\p{Ll}]"), _pick("áàâäåæçéèêëíìîïñóòôöøúùûü", n))
            .when(c.rlike(r"[\p{IsLatin}&&\p{Lu}]"), _pick("ÁÀÂÄÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖØÚÙÛÜ", n))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), _pick("абвгдежзиклмнопрстуфхцчшэюя", n))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", n))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _pick("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike(r"\p{N}"), _pick("0123456789", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), "")


def _hex_alike(s: Column, h: Column) -> Column:
    def chars(alphabet):
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: _pick(alphabet, _byte(h, i))), "")

    return F.when(s.rlike("^[0-9a-f]+$"), chars("0123456789abcdef")).when(s.rlike("^[0-9A-F]+$"), chars("0123456789ABCDEF")).otherwise(_alike(s, h))


def _card(d: Column, h: Column) -> Column:
    """Same issuer digits and length, valid check digit."""
    body = F.concat(F.substring(d, 1, 4), F.array_join(F.transform(F.sequence(F.lit(5), F.length(d) - 1), lambda i: _pick("0123456789", _byte(h, i))), ""))
    rest = _luhn(F.concat(body, F.lit("0")))
    return F.concat(body, ((10 - rest) % 10).cast("string"))


def _name(word: Column, gender: str, h: Column, attempt: Column) -> Column:
    def of(script):
        parts = F.array(*map(F.lit, NAME_PARTS[script]))
        ends = F.array(*map(F.lit, ENDINGS[script, gender]))
        count = F.lit(1 if gender != "s" else 2) + F.floor(attempt / 4).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(parts, _byte(h, i) % 16)), "")
        return F.initcap(F.concat(stem, F.get(ends, _byte(h, F.lit(0)) % 4)))

    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """``kind|surrogate`` for ``kind|canonical form``."""
    k, s = F.substring_index(entity, "|", 1), F.regexp_replace(entity, r"^[a-z_]+\|", "")
    seed = F.concat_ws("\x1f", F.lit(key), entity, attempt.cast("string"))
    h = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))
    domain = F.substring_index(s, "@", -1)
    hosts = F.regexp_replace(domain, r"\.[^.]*$", "")
    host_hash = F.sha2(F.concat(F.lit(key), F.lit("\x1fdomain\x1f"), domain), 512)
    # As with names, later attempts are longer, so that short local parts do not run out.
    longer = F.when(attempt < 4, F.lit("")).otherwise(_alike(F.repeat(F.lit("a"), F.floor(attempt / 4).cast("int")), F.reverse(h)))
    email = F.concat(_alike(F.substring_index(s, "@", 1), h), longer, F.lit("@"), _alike(hosts, host_hash), F.lit(".example"))
    ip = F.concat_ws(".", (_byte(h, F.lit(0)) % 223 + 1).cast("string"), *[_byte(h, F.lit(i)).cast("string") for i in (1, 2)], (_byte(h, F.lit(3)) % 254 + 1).cast("string"))
    # A phone number keeps its country code, or the digits that stand for one.
    lead = F.greatest(F.length(s) - 10, F.lit(0))
    phone = F.concat(F.substring(s, F.lit(1), lead), _alike(F.substring(s, lead + 1, F.lit(20)), h))
    made = (
        F.when(k == "email", email)
        .when(k == "ip", ip)
        .when(k == "phone", phone)
        .when(k == "card", _card(s, h))
        .when(k == "ssn", F.concat(F.lit("9"), F.substring(_alike(s, h), 2, 8)))
        .when(k == "given_f", _name(s, "f", h, attempt))
        .when(k == "given_m", _name(s, "m", h, attempt))
        .when(k == "surname", _name(s, "s", h, attempt))
        .otherwise(_hex_alike(s, h))
    )
    return F.concat(k, F.lit("|"), made)


def surrogates(distinct: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate): one distinct surrogate for every distinct entity.

    Each round hashes what is open; of entities that meet in one surrogate the smallest
    keeps it, unless it is taken or is itself an entity, and the others go on.
    """
    given = distinct.select("entity")
    open_, done = given, []
    for attempt in range(ROUNDS):
        tried = open_.withColumn("surrogate", surrogate(F.col("entity"), key, F.lit(attempt)))
        first = tried.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        taken = reduce(DataFrame.union, [d.select("surrogate") for d in done], given.select(F.col("entity").alias("surrogate")))
        fixed = written(first.join(taken, "surrogate", "left_anti").select("entity", "surrogate"), "surrogates")
        done.append(fixed)
        open_ = written(open_.join(fixed, "entity", "left_anti"), "open-entities")
        if open_.limit(1).count() == 0:
            return reduce(DataFrame.union, done)
    raise RuntimeError("surrogates ran out")


def _put(e: Column, known: Column) -> Column:
    """The match ``e`` with its entities replaced by what ``known`` has for them."""
    parts = entities(e)
    got = F.transform(parts, lambda p: F.regexp_replace(F.element_at(known, p), r"^[a-z_]+\|", ""))
    k = kind(e)
    title = F.regexp_extract(e, f"^(?i:{_TITLE})\\.? ", 0)
    one = F.get(got, F.lit(0))
    spaced = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(e)),
            lambda i: F.when(
                F.substring(e, i, F.lit(1)).rlike("[0-9]"),
                F.substring(one, F.length(_digits(F.substring(e, F.lit(1), i))), F.lit(1)),
            ).otherwise(F.substring(e, i, F.lit(1))),
        ),
        "",
    )
    plain = (
        F.when(k == "name", F.concat(title, F.array_join(got, " ")))
        .when(k.isin("card", "phone", "ssn"), spaced)
        .otherwise(one)
    )
    rest = F.when(k == "name", F.substring(e, F.length(title) + 1, F.length(e))).otherwise(e)
    cased = k.isin("name", "email") | ((k == "secret") & e.rlike("^[0-9A-F]+$"))
    upper = cased & (rest == F.upper(rest)) & (rest != F.lower(rest))
    kept = F.when(k == "name", title).otherwise("")
    loud = F.concat(kept, F.upper(F.substring(plain, F.length(kept) + 1, F.length(plain))))
    return F.coalesce(F.when(upper, loud).otherwise(plain), e)


_WORD_START, _WORD_END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _names(known: Column, kinds: str) -> Column:
    """(name, surrogate) of the given names or surnames among a text's entities."""
    held = F.filter(F.map_entries(known), lambda x: x["key"].rlike(f"^{kinds}"))
    bare = lambda c: F.regexp_replace(c, r"^[a-z_]+\|", "")
    return F.transform(held, lambda x: F.struct(bare(x["key"]).alias("name"), bare(x["value"]).alias("new")))


def _any_of(names: Column) -> Column:
    """A pattern for the names, capitalised or in capitals; they hold letters only."""
    both = F.flatten(F.transform(names, lambda n: F.array(n["name"], F.upper(n["name"]))))
    return F.concat(F.lit(_WORD_START + "(?:"), F.array_join(both, "|"), F.lit(")" + _WORD_END))


def _refer(piece: Column, given: Column, last: Column) -> Column:
    """Text between matches with the known names in it replaced: given names before a
    known surname, then surnames."""

    def put(text, names, ahead):
        def one(t, n):
            plain = F.regexp_replace(t, F.concat(F.lit(_WORD_START), n["name"], ahead), n["new"])
            return F.regexp_replace(plain, F.concat(F.lit(_WORD_START), F.upper(n["name"]), ahead), F.upper(n["new"]))

        return F.aggregate(names, text, one)

    return put(put(piece, given, F.concat(F.lit("(?= "), _any_of(last), F.lit(")"))), last, F.lit(_WORD_END))


def replace_entities(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all columns and rows are kept.

    ``count`` names an extra column, the number of replaced mentions; one of that name is replaced. Null texts stay null
    and empty ones empty; texts without personal data are not changed in any byte. Equal
    entities get equal surrogates wherever they stand; a table without entities, or an
    empty one, is returned as it is. Running it again on its result replaces surrogates.
    """
    text = F.col("text")
    gated = docs.where(text.rlike(GATE))
    hit = gated.select(F.md5("text").alias("_h"), found(text).alias("_m")).where(F.size("_m") > 0)
    mentions = hit.select("_h", F.explode(F.array_distinct(F.flatten(F.transform("_m", entities)))).alias("entity")).distinct()
    mentions = written(mentions, "mentions")
    chosen = surrogates(mentions.select("entity").distinct(), key)
    maps = mentions.join(chosen, "entity").groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_known"))

    h, e, p, m = fresh(docs, "_h", "_e", "_p", "_known")
    maps = maps.withColumnsRenamed({"_h": h, "_known": m})
    # Only texts that have a chance are hashed and joined; the others pass by.
    keyed = docs.withColumn(h, F.when(text.rlike(GATE), F.md5("text")))
    joined = keyed.where(F.col(h).isNotNull()).join(maps, h, "left")
    with_map = joined.where(F.col(m).isNotNull()).withColumn(e, found(text)).withColumn(p, F.split("text", ANY, -1))
    given, last = _names(F.col(m), "given_"), _names(F.col(m), r"surname\|")
    named = F.size(last) > 0
    pieces = F.when(named, F.transform(p, lambda x: _refer(x, given, last))).otherwise(F.col(p))
    put = F.zip_with(pieces, F.transform(e, lambda x: _put(x, F.col(m))), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    changed = with_map.withColumn("text", F.array_join(put, ""))
    rest = [joined.where(F.col(m).isNull()), keyed.where(F.col(h).isNull())]
    columns = docs.columns
    if count:
        number = F.aggregate(e, F.lit(0), lambda n, x: n + F.when(kind(x).isNotNull(), 1).otherwise(0))
        later = F.aggregate(p, F.lit(0), lambda n, x: n + F.regexp_count(x, _any_of(last)))
        changed = changed.withColumn(count, number + F.when(named, later).otherwise(0))
        rest = [f.withColumn(count, F.lit(0)) for f in rest]
        columns = [c for c in columns if c.lower() != count.lower()] + [count]
    return reduce(DataFrame.union, [f.select(columns) for f in (changed, *rest)])
