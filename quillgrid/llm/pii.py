"""PII surrogates in DataFrame operations: keyed, type-consistent replacements with collision checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_GAP = r"[^\p{L}\p{N}\n]{1,5}"
#: Titles and phrases that go before a name.
TITLES = (
    r"Mr\.?", "Mister", "Herr", r"M\.", "Monsieur", r"Sr\.", "Señor", "Sir", r"Mrs\.?", r"Ms\.?", "Miss", "Frau", r"Mme\.?", "Madame", "Mlle", r"Sra\.", "Señora", "Lady", r"Dr\.?", r"Prof\.?",
    "[Mm]y name is", "[Ii]ch heiße", "[Mm]ein Name ist", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]i nombre es",
)
#: Common given names, by gender. One of them before another capitalised word is a person's name without any title.
GIVEN = {
    "f": "Alice Amelia Amy Ana Andrea Angela Anna Anne Barbara Beatriz Camille Carmen Carla Caroline Catherine Charlotte Chloe Christine Clara Claire Elena Elisabeth Elizabeth Emily Emma Eva Fatima Grace Hannah "
    "Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucia Margaret Maria María Marie Martha Mary Michelle Monika Natalia Nicole Olga Olivia Patricia Petra Rachel Sabine Sarah "
    "Sofia Sophie Susan Ursula Анна Елена Мария Ольга Ирина Наталья Μαρία Ελένη",
    "m": "Adam Ahmed Alejandro Alexander Andreas Andrew Anthony Antoine Antonio Benjamin Bernd Carlos Charles Christian Christopher Claude Daniel David Diego Edward Fernando Francisco Frank François Fritz George "
    "Hans Henry Heinrich Ivan Jack Jacques James Jan Javier Jean Joachim John Jonas Jorge Joseph José Juan Jürgen Karl Klaus Lars Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Mohammed Nicolas Otto Pablo "
    "Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert Samuel Stefan Stephen Thomas Wolfgang William Иван Сергей Александр Дмитрий Владимир Γιώργος",
}
#: Capitalised words that end a name.
_STOP = "The|An?|In|On|At|He|She|It|Its|We|You|They|I|This|That|These|Those|And|But|Or|If|When|While|Then|There|For|From|To|With|As|By|Of|Der|Die|Das|Ein|Eine|Und|Er|Sie|Es|Wir|Le|La|Les|Un|Une|Et|Il|Elle|El|Los|Las|Una|Y|En"
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
_PART = rf"(?!(?:{_STOP})(?![\p{{L}}\p{{M}}\p{{N}}'’-]))(?:\p{{Lu}}\.(?= \p{{Lu}})|{_WORD})"
_NAME = rf"{_PART}(?:(?: (?:de la|de los|de|del|della|di|da|dos|du|van der|van den|van|von der|von|zu|al|bin|ibn|le|la|el|y|e))? {_PART})*+"
_TITLE = "|".join(TITLES)
_GIVEN = "|".join(" ".join(GIVEN.values()).split())
#: (type, pattern) in order of precedence; the patterns are joined into one, so that entities never overlap.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}" + _END),
    ("secret", rf"{_EDGE}(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[^\p{{L}}\p{{N}}\n=:]{{0,5}}[=:][^\p{{L}}\p{{N}}\n]{{0,5}}(?=[A-Za-z0-9_/+=.-]{{8}})[A-Za-z0-9_/+=-]++(?:\.[A-Za-z0-9_/+=-]++)*+"),
    ("secret", rf"{_EDGE}(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,}}|sk-[A-Za-z0-9_-]{{20,}}|eyJ[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]+)++|[0-9a-f]{{32,}}|[0-9A-F]{{32,}}){_END}"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}+])\+\d{{1,3}}[^\p{{L}}\p{{N}}\n]{{0,5}}\(\d{{2,4}}\){_GAP}\d{{3,4}}[ .-]\d{{3,4}}{_END}"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}{_END}"),
    ("iban", rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"),
    ("card", rf"(?<![\p{{L}}\p{{N}}.-])\d(?:[ -]?\d){{12,18}}{_END}"),
    ("ssn", rf"(?<![\p{{L}}\p{{N}}.-])\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}-])"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}.-])(?:\(\d{{3}}\) ?|\d{{3}}[-.])\d{{3}}[-.]\d{{4}}(?![\p{{L}}\p{{N}}-])"),
    ("ip", rf"(?<![\p{{L}}\p{{N}}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}}(?!\.?[\p{{L}}\p{{N}}])"),
    ("ip6", r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"),
    ("name", rf"{_EDGE}(?:(?:{_TITLE}) {_NAME}|(?=\p{{Lu}})(?:{_GIVEN})(?![\p{{L}}\p{{M}}\p{{N}}'’-]) {_NAME})"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
NAMES = PATTERNS[-1][1]
#: In documents with names, their other capitalised words are looked at too.
WITH_WORDS = rf"{PATTERN}|(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}"
#: (class of characters, replacements): a character becomes one of its own class, so case, script and format stay.
CLASSES = (
    ("[0-9]", "0123456789"), ("[aeiou]", "aeiou"), ("[a-z]", "bcdfghjklmnpqrstvwxz"), ("[AEIOU]", "AEIOU"), ("[A-Z]", "BCDFGHJKLMNPQRSTVWXZ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "áàâäéèêëíìîïóòôöúùûüñç"), (r"[\p{IsLatin}&&\p{Lu}]", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "明华文国安平东南西北春秋山水云天"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそ"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソ"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
)
#: (script, consonants, vowels, endings of women's and of men's names) of invented name parts.
SYLLABLES = (("IsLatin", "bdfgklmnprstv", "aeiou", "a", "nrslo"), ("IsCyrillic", "бвгдзклмнпрст", "аеиоу", "а", "нрвлй"), ("IsGreek", "βγδζκλμνπρστ", "αειου", "α", "ς"))
#: From this attempt on a format with too few values gives way.
SCARCE = 12
#: Values a task makes surrogates for.
TASK_VALUES = 2_000


def entity_type(value: Column) -> Column:
    """The first type whose pattern is all of an entity; else null (a plain capitalised word)."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), name).otherwise(kind)
    return kind


def _random(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """A long hexadecimal string that only the key's holder can tell (four SHA-512 digests)."""
    seed = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(k)), F.lit(key)), 512)
    return F.concat(*(seed(k) for k in range(4)))


def _draw(noise: Column, i: Column) -> Column:
    """The i-th number (0 to 4095) of the noise, which repeats after 170."""
    return F.conv(F.substr(noise, i % 170 * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _masked(value: Column, noise: Column, hexadecimal: Column | None = None) -> Column:
    """Every letter and digit replaced within its class; the rest stays. Of a value over 170 characters the noise repeats."""

    def one(c: Column, i: Column) -> Column:
        r, out = _draw(noise, i), c
        for pattern, letters in reversed(CLASSES):
            out = F.when(F.rlike(c, F.lit(pattern)), F.substr(F.lit(letters), r % len(letters) + 1, F.lit(1))).otherwise(out)
        if hexadecimal is not None:
            for pattern, letters in (("[a-f]", "abcdef"), ("[A-F]", "ABCDEF")):
                out = F.when(hexadecimal & F.rlike(c, F.lit(pattern)), F.substr(F.lit(letters), r % 6 + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(value), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counting once."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substr(digits, i, F.lit(1)).try_cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def _card(masked: Column) -> Column:
    """A masked card number with a right check digit."""
    digits = F.regexp_replace(masked, r"\D", "")
    off = luhn_sum(F.concat(F.substr(digits, F.lit(1), F.char_length(digits) - 1), F.lit("0")))
    return F.concat(F.substr(masked, F.lit(1), F.char_length(masked) - 1), ((10 - off % 10) % 10).cast("string"))


def _iban(value: Column, masked: Column) -> Column:
    """A masked account number whose country stays; check digits are made right."""
    country = F.substr(value, F.lit(1), F.lit(2))
    bare = F.concat(F.regexp_replace(F.substr(masked, F.lit(5)), " ", ""), country, F.lit("00"))
    number = F.array_join(F.transform(_chars(bare), lambda c: F.when(F.rlike(c, F.lit("[A-Z]")), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rest = F.aggregate(F.filter(_chars(number), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(masked, F.lit(5)))


def _ip(value: Column, noise: Column) -> Column:
    octets = F.split(value, r"\.")
    part = lambda o, i: let(F.conv(F.substr(noise, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), lambda r: F.when(F.char_length(o) == 1, r % 10).when(F.char_length(o) == 2, 10 + r % 90).otherwise(100 + r % 155))
    return F.array_join(F.transform(octets, lambda o, i: part(o, i).cast("string")), ".")


def _name_part(value: Column, masked: Column, noise: Column, attempt: Column) -> Column:
    """An invented lower-case name part: as long, in the same script, consonants and vowels in turn, and with an ending of the gender where ``value``
    is a given name of one; else the last letter stays. Where such names are scarce, they grow by syllables."""
    out = F.concat(masked, F.substr(value, F.char_length(value)))
    women, men = (value.isin(*(n.lower() for n in GIVEN[g].split())) for g in "fm")
    pick = lambda letters, r: F.substr(F.lit(letters), r % len(letters) + 1, F.lit(1))
    for script, consonants, vowels, female, male in SYLLABLES:
        more = F.when(attempt >= SCARCE, F.concat(*(pick(x, _draw(noise, F.lit(160 + k))) for k, x in enumerate((consonants, vowels) * 3)))).otherwise("")
        start = _draw(noise, F.lit(169)) % 2
        sound = lambda c, i, n: F.when(~F.rlike(c, F.lit(r"\p{L}")), c).when((i + start) % 2 == 0, pick(consonants, _draw(noise, i))).otherwise(pick(vowels, _draw(noise, i)))
        body = F.array_join(F.transform(_chars(F.substr(value, F.lit(1), F.char_length(value) - 1)), lambda c, i: F.when(c == "", c).otherwise(sound(c, i, value))), "")
        end = F.when(women, pick(female, _draw(noise, F.lit(168)))).when(men, pick(male, _draw(noise, F.lit(168)))).otherwise(F.substr(value, F.char_length(value)))
        out = F.when(F.rlike(value, F.lit(rf"^\p{{{script}}}")), F.concat(body, more, end)).otherwise(out)
    return out


def _cased(made: Column, like: Column) -> Column:
    """Lower-case ``made`` with capitals where ``like`` has them; all in capitals if it is."""
    each = F.zip_with(_chars(made), _chars(like), lambda a, b: F.when(F.coalesce(b != F.lower(b), F.lit(False)), F.upper(a)).otherwise(F.coalesce(a, F.lit(""))))
    return F.when((like == F.upper(like)) & (F.char_length(like) > 1), F.upper(made)).otherwise(F.array_join(each, ""))


def _head(value: Column) -> Column:
    """The title or phrase before a name, with its blank; "" for a name without one."""
    return F.regexp_extract(value, rf"^(?:{_TITLE}) ", 0)


def _tokens() -> Column:
    """The blank-separated parts of a name, without its head."""
    value = F.col("value")
    return F.split(F.substr(value, F.char_length(_head(value)) + 1), " ")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, site, attempt) -> with ``surrogate``, of the same type and format; ``site`` is the surrogate of an e-mail address's domain."""
    kind, value, attempt, noise, masked = (F.col(c) for c in ("type", "value", "attempt", "noise", "masked"))
    head = F.regexp_extract("value", r"^([^=:]*[=:][^\p{L}\p{N}]{0,6}?(?=[A-Za-z0-9_/+=.-]{8})|AKIA|gh[pousr]_|sk-|eyJ)", 1)
    lead = F.when(kind == "secret", head).when(kind == "phone", F.regexp_extract("value", r"^(\+\d{1,3})?", 0)).otherwise("")
    top = F.when(kind == "domain", F.concat(F.lit("."), F.substring_index(value, ".", -1))).when(kind == "part", F.substr(value, F.char_length(value))).otherwise("")
    body = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(F.substr(value, F.char_length("lead") + 1, F.char_length(value) - F.char_length("lead") - F.char_length("top")))
    hexadecimal = (kind == "ip6") | (kind == "secret") & F.rlike("body", F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    spare = F.when(attempt >= SCARCE, F.concat(F.lit("-"), F.substr(noise, F.lit(1), F.lit(12)))).otherwise("")
    prepared = entities.withColumn("noise", _random(key, kind, value, attempt)).withColumns({"lead": lead, "top": top}).withColumn("body", body)
    prepared = prepared.withColumn("masked", _masked(F.col("body"), noise, hexadecimal))
    made = (
        F.when(kind == "email", F.concat(masked, spare, F.lit("@"), F.col("site")))
        .when(kind == "card", F.concat(_card(masked), spare))
        .when(kind == "iban", F.concat(_iban(value, masked), spare))
        .when(kind == "ip", F.concat(_ip(value, noise), spare))
        .when(kind == "part", _name_part(value, masked, noise, attempt))
        .otherwise(F.concat("lead", masked, spare, "top"))
    )
    return prepared.select("type", "value", "site", "attempt", made.alias("surrogate"))


def distinct_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(type, value, site), all different -> (type, value, surrogate): no two values of a type share one, and none is itself a value of the type.

    Of values that meet in one surrogate the smallest keeps it and the others try again, until none meet; so a result
    depends on nothing but the set of values and the key. Minima are aggregated map-side. A format with too few values for all entities
    gives way from the twelfth attempt on; being distinct does not.
    """
    open_, done = values.withColumn("attempt", F.lit(0)), None
    taken = values.select(F.col("type").alias("t"), F.col("value").alias("s"))
    while True:
        tasks = 1 + open_.count() // TASK_VALUES
        tried = cut(surrogates(open_.repartition(tasks, "type", "value"), key))
        clean = tried.join(taken, (F.col("type") == F.col("t")) & (F.col("surrogate") == F.col("s")), "left_anti")
        winners = cut(clean.groupBy("type", "surrogate").agg(F.min("value").alias("value")))
        done = winners if done is None else done.unionByName(winners)
        open_ = tried.join(winners.select("type", "value"), ["type", "value"], "left_anti").select("type", "value", "site", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return done
        taken = taken.unionByName(winners.select(F.col("type").alias("t"), F.col("surrogate").alias("s")))


def _found(docs: DataFrame) -> DataFrame:
    """(id, version, pos, value, type) of every hit; type is null for capitalised words, which are listed only in documents with a name. Numbers in the format of a card without its check digit are none."""
    hits = F.posexplode(F.regexp_extract_all("text", _pattern(), F.lit(0))).alias("pos", "value")
    found = docs.where(F.rlike("text", F.lit(PATTERN))).select("id", "version", hits).distinct().withColumn("type", entity_type(F.col("value")))
    return found.withColumn("type", F.when((F.col("type") != "card") | (luhn_sum(F.regexp_replace("value", r"\D", "")) % 10 == 0), F.col("type")))


def _pattern() -> Column:
    return F.when(F.rlike("text", F.lit(NAMES)), F.lit(WITH_WORDS)).otherwise(F.lit(PATTERN))


def _new_names(found: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """(id, version, pos, new) of names, part by part, and of later or earlier mentions of their parts in the same document."""
    at = ["id", "version", "pos"]
    tokens = found.where("type = 'name'").select(*at, _head(F.col("value")).alias("head"), F.posexplode(_tokens()).alias("k", "token"))
    initial = F.concat(F.upper(F.substr(F.lit("bcdfghjklmnprstvw"), _draw(_random(key, F.lit("initial"), F.col("token"), F.lit(0)), F.lit(0)) % 17 + 1, F.lit(1))), F.lit("."))
    part = F.when(F.rlike("token", F.lit(r"^\p{Lu}")) & ~F.rlike("token", F.lit(r"^\p{Lu}\.$")), F.lower("token"))
    surrogate = made.where("type = 'part'").select(F.col("value").alias("part"), "surrogate")
    parts = cut(tokens.withColumn("part", part).join(surrogate, "part", "left"))
    new = F.when(F.col("surrogate").isNotNull(), _cased(F.col("surrogate"), F.col("token"))).when(F.rlike("token", F.lit(r"^\p{Lu}\.$")), initial).otherwise(F.col("token"))
    named = parts.withColumn("new", new).groupBy(*at, "head").agg(F.sort_array(F.collect_list(F.struct("k", "new"))).alias("p"))
    named = named.select(*at, F.concat("head", F.array_join(F.transform("p", lambda x: x["new"]), " ")).alias("new"))
    own = parts.where("surrogate is not null and char_length(part) > 1").select(F.col("id").alias("i"), F.col("version").alias("v"), "part", "surrogate").distinct()
    words = found.where("type is null").withColumn("low", F.lower("value"))
    bare = words.join(own, F.expr("id <=> i and version = v and low = part")).select(*at, _cased(F.col("surrogate"), F.col("value")).alias("new"))
    return named.unionByName(bare)


def replace_pii(documents: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities): every document with its personal data replaced by surrogates.

    Found are e-mail addresses, assigned or well-known secrets, phone, card (with a right check digit), account and social-security numbers, IP
    addresses of both kinds, and names: those after a title or a phrase of introduction, and those that begin with one of a list of common given names. Every
    other mention of a part of such a name in the same document, with a capital or in capitals, is replaced too; a given name alone in a
    document that has it nowhere else in full is not found, nor are mentions in lower case.

    A surrogate depends on ``key``, the type and the value, and keeps the format: digits for digits, letters of
    the same case and script, the domain's ending, a phone's and an account's country code, right check digits, a name's title. Parts of names
    become invented ones of the same length, script and case, with an ending of the gender of a known given name (else the last letter stays). The
    same value has the same surrogate everywhere, names part by part ("Mr. A B" and "Mr. B"), and e-mail addresses of one domain share one. Values
    (domains and name parts too) never share a surrogate, nor is a surrogate a value found in the documents; a format with too few
    values gives way to that. Only initials ("J.") may meet.

    Null text stays null, with no entities; text without any is unchanged; an empty table gives an empty one. There is no bound on a value's length. Rows that repeat id and text,
    and null ids, are treated like any. Other columns are ignored. Entities are counted once per value (map-side first), so a value in very many documents is one row.
    """
    at = ["id", "version", "pos"]
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    found = cut(_found(docs))
    plain = found.where("type is not null and type <> 'name'")
    site = F.substring_index("value", "@", -1)
    parts = found.where("type = 'name'").select(F.explode(_tokens()).alias("token"))
    parts = parts.where(F.rlike("token", F.lit(r"^\p{Lu}")) & ~F.rlike("token", F.lit(r"^\p{Lu}\.$"))).select(F.lit("part").alias("type"), F.lower("token").alias("value"))
    domains = plain.where("type = 'email'").select(F.lit("domain").alias("type"), site.alias("value"))
    none = F.lit(None).cast("string").alias("site")
    first = cut(plain.where("type <> 'email'").select("type", "value").unionByName(parts).unionByName(domains).distinct())
    made = cut(distinct_surrogates(first.select("type", "value", none), key))
    mails = plain.where("type = 'email'").select("type", "value", site.alias("at")).distinct().join(made.where("type = 'domain'").select(F.col("value").alias("at"), F.col("surrogate").alias("site")), "at")
    made = made.unionByName(distinct_surrogates(cut(mails.select("type", "value", "site")), key))
    new = plain.join(made, ["type", "value"]).select(*at, F.col("surrogate").alias("new")).unionByName(_new_names(found, made, key))
    every = found.select(*at, F.col("value").alias("new"), F.lit(0).alias("changed")).unionByName(new.withColumn("changed", F.lit(1)))
    hits = every.groupBy(*at).agg(F.max(F.struct("changed", "new")).alias("h"))
    per = cut(hits.groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("pos", "h.new"))).alias("hits"), F.sum("h.changed").alias("n")).where("n > 0"))
    # always by shuffle, as the documents with entities grow with the input
    there = docs.alias("d").join(per.alias("x").hint("merge"), F.expr("d.id <=> x.id and d.version <=> x.version"), "left")
    woven = F.array_join(F.zip_with(F.split("text", _pattern()), F.transform("hits", lambda h: h["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return there.select(F.col("d.id").alias(id_col), F.when(F.col("hits").isNull(), F.col("text")).otherwise(woven).alias(text_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))
