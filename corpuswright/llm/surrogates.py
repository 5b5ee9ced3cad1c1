"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, telephone, card, account (IBAN) and social-security numbers, IP addresses of both kinds and
names, which a title or a phrase such as `my name is` announces. Spellings of an entity share a canonical form: lower case,
digits without country prefix, addresses written out. A name's entities are its words, so `Mr. Weber`, `MR WEBER` and
`Mr Adam Weber` share one; in a document with a name, each further capitalised word that is one of its words is a mention too.

A keyed hash of the canonical form gives the replacement. It keeps kind, format and case, for names the script and the gender
that the titles tell, and for card and account numbers the check digits. So all mentions of an entity, in all documents, are
replaced alike. Collision checks run over the distinct entities: whoever's surrogate is taken, or is itself an entity of the
corpus, tries the next hash until all differ; names and mail addresses grow with each attempt, so there are always enough.

Texts without a match pass straight through. What shuffles are the mentions (a narrow row each), distinct entities, and texts
with a match once. An entity that a third of all documents mention is one row in the checks, and AQE splits its join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_rows, written

_WOMEN = "Mrs|Ms|Miss|Madam|Lady|Dame|Frau|Fräulein|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Госпожа|Г-жа|Κυρία"
_MEN = "Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|Г-н|Κύριος"
_OTHERS = "Mx|Dr|Prof|Professor|Professorin|Professeur|Profesor|Profesora|Доктор|Профессор"
_PARTICLES = "van von de der den del della da di dos du la le zu zur af av bin ibn al el y".split()
_CUES = ("my name is", "My name is", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут")


def _cases(titles: str) -> str:
    """A title as it stands, in capitals and, where it is not Latin, in small letters; longer ones first."""
    every = {f for t in titles.split("|") for f in (t, t.upper(), *([t.lower()] if t[0] > "Ͱ" else []))}
    return "|".join(sorted(every, key=lambda t: (-len(t), t)))


_TITLES = _cases("|".join((_WOMEN, _MEN, _OTHERS)))
_LETTERS = r"[\p{L}\p{M}]"
#: A word of a name: an apostrophe belongs to it, unless it is that of a genitive.
_WORD = rf"{_LETTERS}++(?:['’](?!s(?!{_LETTERS})){_LETTERS}++){{0,9}}+"
_NAME = rf"(?:\p{{Lu}}\.(?=\x20?(?:\p{{Lu}}|(?:{'|'.join(_PARTICLES)})\x20))|(?=\p{{Lu}}){_WORD}(?:-{_WORD}){{0,9}}+)"
_PARTICLE = rf"(?:(?:{'|'.join(_PARTICLES)})\x20){{0,3}}"
_NAMES = rf"{_PARTICLE}{_NAME}(?:\x20{_PARTICLE}{_NAME}){{0,3}}+"
_CUED = rf"(?:{'|'.join(_CUES)})\x20"
_LEAD = rf"(?:{_CUED}(?:(?:{_TITLES})\.?\x20){{0,4}}+|(?:(?:{_TITLES})\.?\x20){{1,4}}+)"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){1,127}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\d)",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[^\s\d]{{0,38}}\d)(?:{_HEX}(?::{_HEX}){{7}}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{0,5}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?:(?<![\w+])\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|(?<!\d)\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?<![\w+])(?=\+(?:[ .\-/()]{0,3}\d){8,15}+(?!\d)|00[1-9]\d{0,2}[ .\-/])(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?!\d)|(?<![\w.+])0\d(?:[ .\-]\d{2}){4}(?!\d)|(?<![\w.+])\(?0\d{2,4}\)?[ /\-]\d{5,8}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_LEAD}{_NAMES}",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same, and every other word with a capital: read only in texts that have a name.
LOOSE = rf"{ALL}|(?:(?<![\p{{L}}\p{{M}}\p{{N}}'’])(?=\p{{Lu}}){_WORD})"
_HEADS = "".join(sorted({t[0] for t in _TITLES.split("|")}))
#: What every match has a part of, tried only where its first character stands.
MAYBE = rf"(?=[0-9:@{_HEADS}])(?:@|[0-9](?:[0-9][0-9]|[0-9]?[ .\-][0-9])|:[0-9A-Fa-f]{{0,4}}:|(?<![\p{{L}}\p{{N}}])(?:{_TITLES})[. ])"
#: The country calling codes of one and two digits; all others have three.
_COUNTRY = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_FIRST = {
    ("latin", "f"): "Ada Bella Clara Dora Elena Flora Greta Hanna Irma Jana Karla Lena Marta Nora Olga Petra",
    ("latin", "m"): "Adam Bruno Conrad David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лада Мария Нина Ольга Полина Раиса София",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Марк Никита Олег Павел Роман Семён",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ξένια Όλγα Πηνελόπη Σοφία Χριστίνα",
    ("greek", "m"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιωάννης Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σπύρος Τάσος Φώτης Χρήστος",
}
_SYLLABLES = {
    "latin": "ba ce di fo gu ha ke li mo nu pa re si to vu za", "cyrillic": "ба ве ги до жу за ке ли мо ну па ре си то фу ха",
    "greek": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φε χι ψο",
}
_ENDINGS = {
    ("latin", "f"): "na la ra ta", ("latin", "m"): "n r s k", ("cyrillic", "f"): "на ла ра та", ("cyrillic", "m"): "н р с к",
    ("greek", "f"): "να λα ρα τα", ("greek", "m"): "νας λας ρος τος",
}
_NUMBERS = ("phone", "ssn", "card", "iban")


def kind_of(value: Column) -> Column:
    out = F.when(F.contains(value, F.lit("@")), "email")
    for kind in ("iban", "ssn", "card", "ipv4", "ipv6"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.when(value.rlike(r"^[+(]?\d"), "phone").otherwise("name")


def _full_ipv6(value: Column) -> Column:
    """Eight groups without leading zeros."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    low = F.lower(value)
    left, right = groups(F.substring_index(low, "::", 1)), F.when(F.contains(low, F.lit("::")), groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    middle = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, middle, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical_of(kind: Column, value: Column) -> Column:
    """One form for all spellings of an entity that is not a name; a telephone number's is without country and trunk prefix."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = F.regexp_replace(F.regexp_replace(digits, "^00", ""), f"^(?:{_COUNTRY})(?=\\d{{5}})", "")
    national = F.regexp_replace(F.when(value.rlike(r"^(?:\+|00)"), abroad).otherwise(digits), "^0+(?=.)", "")
    return (
        F.when(kind == "phone", national).when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "ipv6", _full_ipv6(value)).otherwise(F.lower(value))
    )


def digest_of(kind: Column, canonical: Column, key: str, attempt: Column) -> Column:
    """256 hexadecimal digits that the key, the entity and the attempt give. To be stored as a column before it is used: each
    letter of a surrogate reads it again."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"/{k}")), 256) for k in range(4)))


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th number from 0 to 255 of a digest, around its end if need be."""
    at = (i if isinstance(i, Column) else F.lit(i)) % 128
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), n % len(options) + 1)


def _scramble(value: Column, digest: Column, shift: int = 0) -> Column:
    """Each letter becomes a letter of its case and each digit a digit; other characters stay."""
    small, large, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("0123456789")

    def one(ch: Column, i: Column) -> Column:
        n = _byte(digest, i + shift)
        letter = F.substring(F.when(ch == F.lower(ch), small).otherwise(large), n % 26 + 1, F.lit(1))
        return F.when(ch.between("0", "9"), F.substring(digits, n % 10 + 1, F.lit(1))).when(ch.rlike(r"\p{L}"), letter).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column, double_last: bool) -> Column:
    """The sum of the digits, from the right, every second doubled and less nine if that has two digits; modulo ten."""

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == (0 if double_last else 1), F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), worth), F.lit(0), lambda acc, n: acc + n) % 10


def _mod97(letters: Column) -> Column:
    def add(acc: Column, ch: Column) -> Column:
        return F.when(ch.between("0", "9"), acc * 10 + ch.cast("int")).otherwise(acc * 100 + F.ascii(ch) - 55) % 97

    return F.aggregate(F.split(letters, ""), F.lit(0), add)


def _name_surrogate(canonical: Column, digest: Column, attempt: Column, given: Column, gender: Column) -> Column:
    """A word in small letters: the attempts' numbers of syllables differ, so there is room for any number of names."""
    script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    sex = F.when(gender.isin("f", "m"), gender).when(_byte(digest, 0) % 2 == 0, "f").otherwise("m")
    out = F.lit(None).cast("string")
    for s, syllables in _SYLLABLES.items():
        spelt = lambda n, of=syllables.split(): F.array_join(F.transform(F.sequence(F.lit(2), n + 1), lambda i: _pick(of, _byte(digest, i))), "")
        first = F.lit(None).cast("string")
        for g in ("f", "m"):
            longer = F.concat(spelt(attempt + 1), _pick(_ENDINGS[s, g].split(), _byte(digest, 1)))
            first = F.when(sex == g, F.when(attempt == 0, _pick(_FIRST[s, g].lower().split(), _byte(digest, 1))).otherwise(longer)).otherwise(first)
        out = F.when(script == s, F.when(given, first).otherwise(spelt(attempt + 4))).otherwise(out)
    return out


def surrogate_of(kind: Column, canonical: Column, digest: Column, attempt: Column, given: Column, gender: Column) -> Column:
    """The canonical form of the replacement."""
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    host, top = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)
    more = F.left(F.regexp_replace(F.right(digest, F.lit(64)), "[0-9]", "g"), F.greatest(F.lit(0), attempt - 1))
    email = F.concat(_scramble(local, digest), more, F.lit("@"), _scramble(host, digest, 64), F.lit(".example."), top)
    leading = F.substring(F.lit("23456789"), _byte(digest, 120) % 8 + 1, F.lit(1))
    phone = F.concat(leading, F.substring(_scramble(canonical, digest), F.lit(2), F.length(canonical)))
    digits = _scramble(canonical, digest)
    payload = F.left(digits, F.length(digits) - 1)
    card = F.when(_luhn(canonical, False) == 0, F.concat(payload, ((10 - _luhn(payload, True)) % 10).cast("string"))).otherwise(digits)
    country, inner = F.left(canonical, F.lit(2)), F.substring(_scramble(canonical, digest), F.lit(5), F.length(canonical))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(inner, country, F.lit("00")))).cast("string"), 2, "0"), inner)
    octets = F.concat_ws(".", *((_byte(digest, k) % 254 + 1).cast("string") for k in range(4)))
    groups = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *(F.regexp_replace(F.substring(digest, 4 * k + 1, 4), "^0+(?=.)", "") for k in range(6)))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", digits)
        .when(kind == "iban", iban).when(kind == "ipv4", octets).when(kind == "ipv6", groups)
        .otherwise(_name_surrogate(canonical, digest, attempt, given, gender))
    )


def _cased(word: Column, surrogate: Column) -> Column:
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(surrogate)).otherwise(F.concat(F.upper(F.left(surrogate, F.lit(1))), F.substring(surrogate, F.lit(2), F.length(surrogate))))


def _initial(letter: Column, key: str) -> Column:
    """An initial moves by a keyed distance in its alphabet."""
    out = letter
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
        step = 1 + F.pmod(F.crc32(F.concat(F.lit(key), F.lit(alphabet))), F.lit(len(alphabet) - 1))
        at = F.position(letter, F.lit(alphabet))
        out = F.when(at > 0, F.substring(F.lit(alphabet), ((at - 1 + step) % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def spell_like(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate that is not a name in the format and case of the spelling that it stands in for. Of a number only the last
    characters are the entity; a prefix before them stays."""
    sign = lambda ch: ch.rlike("[0-9]") | ((kind == "iban") & ch.rlike("[A-Z]"))
    count = F.size(F.filter(F.split(value, ""), sign))

    def pour(acc: Column, ch: Column) -> Column:
        own = sign(ch)
        k = acc["k"] + own.cast("int")
        return F.struct(F.concat(acc["out"], F.when(own & (k > 0), F.substring(surrogate, k, F.lit(1))).otherwise(ch)).alias("out"), k.alias("k"))

    poured = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), (F.length(surrogate) - count).alias("k")), pour)["out"]
    cased = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin(*_NUMBERS), poured).otherwise(cased)


def assign_surrogates(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """kind, canonical, surrogate for distinct (kind, canonical) rows with given and gender: all different in a kind, and none
    an entity itself.

    In a round the open entities try a hash each; of those who share a surrogate the least form has it, unless it is taken.
    The others go on, so a round costs what is still open.
    """
    e = (F.col("kind"), F.col("canonical"))
    state = cut(entities.select("kind", "canonical", "given", "gender"))
    taken = state.select("kind", F.col("canonical").alias("surrogate"))
    settled: list[DataFrame] = []
    for attempt in range(rounds):
        tried = cut(state.withColumn("digest", digest_of(*e, key, F.lit(attempt))))
        tried = cut(tried.withColumn("surrogate", surrogate_of(*e, F.col("digest"), F.lit(attempt), F.col("given"), F.col("gender"))).drop("digest"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        used = taken.join(first.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").distinct()
        winners = cut(first.join(used, ["kind", "surrogate"], "left_anti").select("kind", "canonical", "surrogate"))
        settled.append(winners)
        state = cut(tried.drop("surrogate").join(winners.select("kind", "canonical"), ["kind", "canonical"], "left_anti"))
        if state.isEmpty():
            out = settled[0]
            for more in settled[1:]:
                out = out.unionByName(more)
            return out
        taken = taken.unionByName(winners.select("kind", "surrogate"))
    raise ValueError(f"entities still share surrogates after {rounds} rounds: their format has too few values for them")


def _mentions() -> Column:
    """What the pattern finds in a text, in order."""
    none = F.array().cast("array<string>")
    maybe = F.col("text").rlike(MAYBE)
    for cue in _CUES:
        maybe = maybe | F.contains("text", F.lit(cue))
    return F.when(maybe, F.regexp_extract_all(F.col("text"), F.lit(ALL), F.lit(0))).otherwise(none)


def _parts(kind: Column, value: Column, sure: Column) -> Column:
    """The entities of a mention: (canonical, given, gender) of each word of a name, or one for anything else. Account numbers
    that fail their check are none."""
    title = F.regexp_extract(value, f"^{_LEAD}", 0)
    titles = F.lower(F.regexp_replace(title, r"\.", ""))
    told = lambda names: titles.rlike(f"(?<![\\p{{L}}])(?:{names.lower()})\\x20")
    gender = F.when(told(_WOMEN), "f").when(told(_MEN), "m").otherwise("n")
    words = F.regexp_extract_all(F.substring(value, F.length(title) + 1, F.length(value)), F.lit(_WORD), F.lit(0))
    whole = lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*_PARTICLES)
    count = F.size(words)
    named = F.transform(
        words,
        lambda w, i: F.struct(F.when(whole(w), F.lower(w)).alias("canonical"), (sure & (i < count - 1)).alias("given"), F.when(sure & (i < count - 1), gender).alias("gender")),
    )
    plain = canonical_of(kind, value)
    real = (kind != "iban") | (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))) == 1)
    other = F.array(F.struct(F.when(real, plain).alias("canonical"), F.lit(False).alias("given"), F.lit(None).cast("string").alias("gender")))
    return F.when(kind == "name", named).otherwise(other)


def _spelt(key: str) -> Column:
    """A mention with its parts' surrogates (an array in their order; null where a part stays)."""
    value, subs = F.col("value"), F.col("subs")
    title = F.regexp_extract(value, f"^{_LEAD}", 0)
    rest = F.substring(value, F.length(title) + 1, F.length(value))
    words, between = F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), F.split(rest, _WORD, -1)
    initial = lambda w: F.when((F.length(w) == 1) & (F.col("sure")), _initial(w, key)).otherwise(w)
    swapped = F.zip_with(words, subs, lambda w, s: F.when(s.isNull(), initial(w)).otherwise(_cased(w, s)))
    name = F.concat(title, F.array_join(F.zip_with(between, swapped, lambda b, w: F.concat(b, F.coalesce(w, F.lit("")))), ""))
    return F.when(F.col("kind") == "name", name).otherwise(spell_like(F.col("kind"), value, F.element_at(subs, 1)))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, and n_entities (mentions replaced) for every row of `docs`.

    Null texts are empty; texts without a match are returned as they are. Repeated rows give a row each, rows without doc_id
    too; an empty table gives an empty result; other columns are ignored. A name of one letter and a particle are no entities:
    the letter moves by a keyed distance, the particle stays. ValueError if a format has fewer values than the corpus entities
    (numbers and IP addresses keep theirs).
    """
    rows = text_rows(docs)
    sure = _mentions()
    titled = F.exists("found", lambda v: kind_of(v) == "name")
    loose = F.regexp_extract_all(F.col("text"), F.lit(LOOSE), F.lit(0))
    held = rows.withColumn("found", sure).where(F.size("found") > 0).withColumn("named", titled)
    held = written(held.withColumn("found", F.when(F.col("named"), loose).otherwise(F.col("found"))).withColumn("rid", F.monotonically_increasing_id()))

    value = F.col("value")
    mentions = held.select("rid", F.posexplode("found").alias("pos", "value")).withColumn("kind", kind_of(value))
    certain = (F.col("kind") != "name") | F.contains(value, F.lit(" "))  # a word that only has a capital stands alone
    mentions = mentions.withColumn("sure", certain)
    parts = mentions.select("rid", "pos", "value", "kind", "sure", F.posexplode(_parts(F.col("kind"), value, F.col("sure"))).alias("part", "p")).select(
        "rid", "pos", "value", "kind", "sure", "part", "p.canonical", "p.given", "p.gender"
    )
    parts = parts.repartition("rid")  # all that follows is by rid, and so needs no further exchange
    own = F.max("sure").over(Window.partitionBy("rid", "kind", "canonical"))
    parts = written(parts.withColumn("canonical", F.when(own, F.col("canonical"))))
    known = parts.where("canonical IS NOT NULL")
    entities = known.groupBy("kind", "canonical").agg(
        F.bool_or("given").alias("given"), F.when(F.count_if(F.col("gender") == "m") == 0, F.when(F.count_if(F.col("gender") == "f") > 0, "f"))
        .when(F.count_if(F.col("gender") == "f") == 0, "m").alias("gender"),
    )
    chosen = assign_surrogates(entities.withColumn("gender", F.coalesce("gender", F.lit("n"))), key)
    told = parts.join(chosen, ["kind", "canonical"], "left").repartition("rid")
    spelt = told.groupBy("rid", "pos").agg(
        F.first("value").alias("value"), F.first("kind").alias("kind"), F.first("sure").alias("sure"), F.count("surrogate").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda s: s["surrogate"]).alias("subs"),
    ).select("rid", "pos", (F.col("n") > 0).alias("hit"), _spelt(key).alias("spelt"))
    per = spelt.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "spelt"))).alias("new"), F.count_if("hit").alias("n_entities"))
    plain = rows.where(F.size(sure) == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    between = F.when(F.col("named"), F.split(F.col("text"), LOOSE, -1)).otherwise(F.split(F.col("text"), ALL, -1))
    swapped = F.zip_with(between, F.transform("new", lambda x: x["spelt"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = held.join(per, "rid").select("doc_id", F.array_join(swapped, "").alias("text"), "n_entities")
    return plain.unionByName(done)
