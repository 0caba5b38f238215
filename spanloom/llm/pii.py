r"""PII surrogates in DataFrame functions only.

1. One pattern finds e-mail and IP addresses, payment cards, phone and social
   security numbers, IBANs, secrets (hex, prefixed, or after password= and the
   like), and names after a title. Texts without any of its starting marks are
   passed on after one cheap look. Cards must pass the Luhn test and IBANs the
   check modulo 97, or they stay as they are. In a text with a titled name, its
   parts are found again wherever they stand as words ("Dr. Ann Lee ... Lee").
   Texts and mentions are staged once, so the pattern runs once over the corpus.
2. A mention becomes entities in canonical form, so that spellings of one thing
   meet: digits alone for numbers (a phone's last ten), lower case for addresses
   and hex secrets; of a name each given name and the family name (the last).
3. Distinct entities (partially aggregated, so a hot one is one row a task) get
   surrogates from a keyed SHA-256: digits for digits, letters of the same case
   and script for letters, octets for octets, check digits that hold. Names come
   from lists by script and gender (told by the titles that a given name has
   anywhere), later ones from syllables of the script.
4. Collision check: a surrogate that equals a real entity of its kind or another
   surrogate is drawn again with the next attempt number, until none is left.
   Thus distinct entities stay distinct and equal ones equal (coreference).
5. Surrogates are joined to the distinct texts with mentions, gathered to one
   map a text, and written into the mention's own layout and case. Texts are
   identified by their SHA-256, so copies are worked out once; texts without
   mentions are never shuffled.

Not found: names that never follow a title, phone numbers without country code,
leading zero or the 3-3-4 layout. Initials in names stay.

Defined results: null text stays null, empty stays empty; a very long text is one
row, matched in time linear in its length; repeated rows get the same
replacement; ids are not used, so null or repeated ones change nothing; an empty
table gives an empty result; all other columns pass through untouched whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, stage

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
_TITLES_M, _TITLES_F, _TITLES_N = "Mr|Herr|Monsieur|Señor|Sr|господин|Κύριος|κ", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|Κυρία|κα", "Dr|Prof|Mx"
_TITLES = f"{_TITLES_M}|{_TITLES_F}|{_TITLES_N}"
_FREE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}[\p{L}'’-]+"
_ASSIGNED = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key) {0,2}[=:] {0,2}[\"']?"
#: Patterns, tried in this order. Each starts at a boundary, and none can match its
#: own parts in two ways, so matching is linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}" + _END,
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": _FREE + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END
    + r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?[0-9]{2,4}){2,5}" + _END
    + r"|(?<![\p{L}\p{N}+.,-])(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,9}(?:[ -][0-9]{1,6}){0,2}" + _END
    + r"|(?<![\p{L}\p{N}+.,-])0[1-9](?:[ .][0-9]{2}){4}" + _END,
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: [A-Z0-9]{1,3})?)" + _END,
    "secret": _FREE + r"(?:(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs)_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z_-]{20,}+|" + _ASSIGNED + r"(?=[^\s\"',;0-9]*+[0-9])[^\s\"',;]{8,}+)(?![\p{L}\p{N}])",
    "name": _FREE + rf"(?:{_TITLES})\.? {_WORD}(?: (?:{_WORD}|\p{{Lu}}\.(?= \p{{Lu}})))*+" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without one of these has no mention: a digit, an address sign, the prefix
#: of a secret that may have no digit, or a title. (Assigned secrets have a digit.)
_START = rf"[@0-9]|(?:AKIA|ASIA)[A-Z]|gh[pos]_[A-Za-z]|sk-[A-Za-z_-]|(?=[DFHMPSгΚκ])(?:{_TITLES})\.? \p{{Lu}}"

#: Given names by gender and script, family names by script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karel Louis Marco Nils Oscar Paul Quentin Ralf Simon Thomas".split(),
    ("f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karin Laura Marta Nora Olga Paula Rita Sofia Tilda Vera".split(),
    ("n", "latin"): "Alexis Bay Charlie Dale Eden Finley Glenn Hayden Indigo Jules Kim Lane Morgan Noel Oakley Perry Quinn Robin Sage Toni".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Кира Лидия Мария Нина".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Паша Тоша".split(),
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
    ("f", "greek"): "Αθηνά Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("n", "greek"): "Άρης Γαβριήλ Κλειώ Φοίβη".split(),
}
FAMILY = {
    "latin": "Abbott Berger Castle Dorner Ekman Fischer Garland Holm Iversen Jansen Keller Lindgren Moreau Novak Olsen Pereira Quist Rossi Santer Tanner Ulrich Varga Weller Yates Zeller".split(),
    "cyrillic": "Антоненко Бондаренко Волошенко Гриценко Демченко Ефименко Иваненко Карпенко Лысенко Мельниченко Назаренко Петренко".split(),
    "greek": "Αγγελίδης Βλάχος Γεωργίου Δημητρίου Καραμάνος Λάσκαρης Νικολάου Παππάς".split(),
}
#: Consonants and vowels of further names, and their endings by gender (family: n).
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v z br dr kl st tr".split(), "a e i o u ai ei ou".split(), {"m": "on", "f": "a", "n": "el"}),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), {"m": "ан", "f": "а", "n": "ко"}),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ".split(), "α ε ι ο ου".split(), {"m": "ος", "f": "α", "n": "ης"}),
}
#: Values that one task draws surrogates for.
DRAWN_A_TASK = 5_000
#: Longer values are drawn whole, not sign by sign.
_LONG = 256


def key_of(spark: SparkSession) -> str:
    """The key of the surrogates, from spanloom.pii.key; whoever runs this on real
    data sets it, the default serves tests and benchmarks."""
    return spark.conf.get("spanloom.pii.key", "spanloom")


def _like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for name in reversed([n for n in PATTERNS if n != "name"]):
        out = F.when(_like(mention, f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(account: Column) -> Column:
    """An IBAN's remainder: its first four signs behind the rest, letters as 10 to 35."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    value = lambda c: F.when(_like(c, "[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _canonical(kind: Column, mention: Column) -> Column:
    digits = _digits(mention)
    bare = F.regexp_replace(mention, f"^{_ASSIGNED}", "")
    plain = F.when(kind.isin("ssn", "card"), digits).when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
    return plain.when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("email", "ip"), F.lower(mention)).when(_like(bare, "^[0-9a-fA-F]+$"), F.lower(bare)).otherwise(bare)


def _valid(kind: Column, mention: Column) -> Column:
    return F.when(kind == "card", _luhn(_digits(mention))).when(kind == "iban", _mod97(F.replace(mention, F.lit(" "), F.lit(""))) == 1).otherwise(True)


def _name_words(mention: Column) -> Column:
    """The words of a name after its title."""
    return F.filter(F.split(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", ""), " "), lambda w: ~_like(w, r"^\p{Lu}\.$"))


def _script(word: Column) -> Column:
    known = F.when(_like(word, r"\p{IsCyrillic}"), "cyrillic").when(_like(word, r"\p{IsGreek}"), "greek")
    return known.when(_like(word, r"\p{IsLatin}"), "latin").otherwise("other")


def _entities(found: Column, families: Column) -> Column:
    """The entities of a mention (text, kind, valid): kind, canonical value and gender.
    Names give one a word; families are the family names of the text, for words
    without a title."""
    mention, kind = found["text"], found["kind"]
    title = F.regexp_extract(mention, rf"^({_TITLES})\.? ", 1)
    gender = F.when(title.isin(_TITLES_M.split("|")), "m").when(title.isin(_TITLES_F.split("|")), "f").otherwise("n")
    words = _name_words(mention)
    last = F.size(words) - 1
    family = lambda w, i: (i == last) & ((last > 0) | (title != "") | F.array_contains(families, w))
    part = lambda w, i: F.struct(F.concat(F.when(family(w, i), "family ").otherwise("given "), _script(w)).alias("kind"), w.alias("value"), F.when(family(w, i), "n").otherwise(gender).alias("gender"))
    other = F.array(F.struct(kind.alias("kind"), _canonical(kind, mention).alias("value"), F.lit("n").alias("gender")))
    return F.when(kind == "name", F.transform(words, part)).when(found["valid"], other).otherwise(F.array().cast("array<struct<kind:string,value:string,gender:string>>"))


def _syllable(byte, heads: list[str], vowels: list[str]):
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), byte(i) % len(names))
    return lambda j: F.concat(pick(heads, 2 * j), pick(vowels, 2 * j + 1))


def _stream(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The keyed stream of a value: 128 bytes in hex."""
    seed = F.concat_ws("\x01", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{n}\x01"), seed), 256) for n in range(4)])


def _draw(kind: Column, value: Column, gender: Column, attempt: Column, stream: Column) -> Column:
    """The surrogate of a canonical value; byte i of the stream decides character i."""
    byte = lambda i: F.conv(F.substring(stream, 1 + 2 * (i % 128), F.lit(2)), 16, 10).cast("int")
    hexed = (kind == "secret") & _like(value, "^[0-9a-f]{32,}$") | (kind == "ip")

    def char(c: Column, i: Column) -> Column:
        latin = F.char(97 + byte(i) % F.when(hexed, 6).otherwise(26))
        letter = F.when(_like(c, r"\p{IsCyrillic}"), F.get(F.array(*map(F.lit, "абвгдежзиклмнопрстуфхцчшщэюя")), byte(i) % 28)).when(_like(c, r"\p{IsGreek}"), F.get(F.array(*map(F.lit, "αβγδεζηθικλμνξοπρτυφχψω")), byte(i) % 23)).otherwise(latin)
        return F.when(_like(c, "[0-9]"), (byte(i) % 10).cast("string")).when(_like(c, r"\p{Lu}"), F.upper(letter)).when(_like(c, r"\p{L}"), letter).otherwise(c)

    scrambled = F.array_join(F.transform(F.split(value, ""), char), "")
    top = F.regexp_extract(value, r"(\.\p{L}+)$", 1)
    fixed = F.when((kind == "secret") & ~hexed, F.regexp_extract(value, "^(AKIA|ASIA|gh[pos]_|sk-)?", 0)).when(kind == "card", F.substring(value, 1, 1)).otherwise("")
    drawn = F.when(F.length(value) > _LONG, F.left(F.repeat(stream, F.ceil(F.length(value) / 256).cast("int")), F.length(value))).otherwise(scrambled)
    body = F.concat(fixed, F.substr(drawn, F.length(fixed) + 1))
    address = F.concat(F.substr(scrambled, F.lit(1), F.length(value) - F.length(top)), top)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + (byte(2 * i) * 256 + byte(2 * i + 1)) % 254).cast("string")), ".")
    # check digits: the one that makes the number pass, the two that leave remainder 1
    number = F.substr(body, F.lit(1), F.length(body) - 1)
    card = F.concat(number, F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(number, d))), 0))
    country, account = F.substring(value, 1, 2), F.substr(scrambled, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    pool = lambda names: F.element_at(F.array(*map(F.lit, names)), 1 + (F.conv(F.substring(stream, 1, 7), 16, 10).cast("int") % len(names)))
    out = F.when(kind == "ip", F.when(F.contains(value, F.lit(":")), scrambled).otherwise(octets)).when(kind == "email", address).when(kind == "card", card).when(kind == "iban", iban)
    named, first = kind.startswith("given") | kind.startswith("family"), attempt == 0
    for (g, s), names in GIVEN.items():
        out = out.when(first & (kind == f"given {s}") & (gender == g), pool(names))
    for s, names in FAMILY.items():
        out = out.when(first & (kind == f"family {s}"), pool(names))
    for s, (heads, vowels, ends) in SYLLABLES.items():
        end = F.element_at(F.create_map(*[F.lit(x) for pair in ends.items() for x in pair]), gender)
        spoken = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1) + attempt), _syllable(byte, heads, vowels)), ""), F.when(kind.startswith("family"), F.lit(ends["n"])).otherwise(end))
        out = out.when(named & kind.endswith(s), F.initcap(spoken))
    # a script without lists: the word's own letters, drawn anew
    own = F.array_distinct(F.split(F.lower(value), ""))
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1 + attempt), lambda i: F.get(own, byte(i) % F.size(own))), "")
    return out.when(named, F.initcap(again)).otherwise(body)


def surrogates(entities: DataFrame, key: str, attempts: int = 40) -> DataFrame:
    """kind, value, surrogate of distinct (kind, value, gender) rows, all surrogates
    of a kind distinct and none a real value of it. Every attempt draws from a
    larger room of names; only kinds whose room the layout bounds can run out."""
    real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
    done, left = None, entities.select("kind", "value", "gender")
    for n in range(attempts):
        # spread first, since drawing is the dear part; few rows stay few files
        spread = left.repartition(1 + left.count() // DRAWN_A_TASK, "value")
        seeded = spread.withColumn("stream", _stream(F.col("kind"), F.col("value"), F.lit(n), key))
        drawn = stage(seeded.select("kind", "value", "gender", _draw(F.col("kind"), F.col("value"), F.col("gender"), F.lit(n), F.col("stream")).alias("surrogate")), "drawn")
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate", F.lit(True).alias("taken")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("first"))
        judged = stage(drawn.join(first, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
                       .select("kind", "value", "gender", "surrogate", (F.col("taken").isNull() & (F.col("value") == F.col("first"))).alias("fine")), "surrogates")
        accepted = judged.filter("fine").select("kind", "value", "surrogate")
        done, left = accepted if done is None else done.unionByName(accepted), judged.filter("not fine").select("kind", "value", "gender")
        if left.isEmpty():
            return done
    raise RuntimeError("surrogates still collide; give more attempts or longer lists")


def _write(found: Column, said: Column) -> Column:
    """A mention with its entities replaced, in its own layout and case. said: the
    surrogates of its entities."""
    mention, kind, new = found["text"], found["kind"], said[0]
    # names: each word but initials by its surrogate, in order
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    words = F.split(F.substr(mention, F.length(title) + 1), " ")
    spoken = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), lambda a, w: F.struct(
        F.when(_like(w, r"^\p{Lu}\.$"), a["n"]).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(F.when(_like(w, r"^\p{Lu}\.$"), w).otherwise(F.get(said, a["n"])))).alias("out")),
        lambda a: F.concat(title, F.array_join(a["out"], " ")))
    # all else: sign by sign, after what a secret is assigned to
    before = F.when(kind == "secret", F.regexp_extract(mention, f"^{_ASSIGNED}", 0)).otherwise("")
    body, digits = F.substr(mention, F.length(before) + 1), _digits(mention)
    head = F.when(kind == "phone", F.left(digits, F.greatest(F.length(digits) - 10, F.lit(0)))).otherwise("")
    signs = F.regexp_replace(F.concat(head, new), r"[^\p{L}\p{N}]", "")

    def place(a: Column, c: Column) -> Column:
        sign, own = F.substring(signs, a["n"] + 1, F.lit(1)), _like(c, r"[\p{L}\p{N}]")
        put = F.when(~own, c).when(_like(c, r"\p{Lu}"), F.upper(sign)).otherwise(sign)
        return F.struct((a["n"] + own.cast("int")).alias("n"), F.concat(a["out"], put).alias("out"))

    laid = F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), place, lambda a: a["out"])
    long = (kind == "secret") & (F.length(body) > _LONG)
    out = F.when(kind == "name", spoken).when((kind == "ip") & ~F.contains(mention, F.lit(":")), new).when(long, F.concat(before, new)).otherwise(F.concat(before, laid))
    return F.when(F.size(said) > 0, out).otherwise(mention)


def _quoted(words: Column) -> Column:
    """Words as one pattern, longest first; letters, marks and spaces alone in them."""
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_join(F.array_sort(F.array_distinct(words), order), "|")


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row: row (the input row), found (array of text, kind and
    whether it is valid), families (the family names told in the text), pattern
    (what cuts the text at the mentions, where it is not the usual one)."""
    body = F.col(f"row.`{text}`").cast("string")
    none = F.array().cast("array<string>")
    found = F.when(_like(body, _START), F.regexp_extract_all(body, F.lit(ANY), 0))
    first = pack(docs).withColumn("first", F.coalesce(found, none))
    names = F.transform(F.filter("first", lambda m: _like(m, PATTERNS["name"])), _name_words)
    named = first.withColumn("names", names)
    again = _quoted(F.concat(F.transform("names", lambda w: F.array_join(w, " ")), F.flatten("names")))
    wide = named.withColumn("pattern", F.when(F.size("names") > 0, F.concat(F.lit(f"{ANY}|{_FREE}(?:"), again, F.lit(f"){_END}"))))
    whole = wide.withColumn("all", F.when(F.size("names") > 0, F.regexp_extract_all(body, F.col("pattern"), F.lit(0))).otherwise(F.col("first")))
    kinds = F.transform("all", lambda m: F.struct(m.alias("text"), _kind(m).alias("kind")))
    checked = whole.withColumn("kinds", kinds).withColumn("found", F.transform("kinds", lambda k: F.struct(k["text"].alias("text"), k["kind"].alias("kind"), _valid(k["kind"], k["text"]).alias("valid"))))
    return checked.select("row", "found", F.transform("names", lambda w: F.element_at(w, -1)).alias("families"), "pattern")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per input row: row (the input row), text with surrogates in place,
    kinds (array: the kind of each mention, in order)."""
    body, c, none = F.col(f"row.`{text}`").cast("string"), F.col, F.array().cast("array<string>")
    marked = stage(mentions(docs, text), "mentions")
    some = F.exists("found", lambda m: m["valid"])
    without = marked.filter(~some).select("row", body.alias("text"), none.alias("kinds"))
    having = marked.filter(some).withColumn("sha", F.sha2(body, 256))
    texts = having.groupBy("sha").agg(F.first("found").alias("found"), F.first("families").alias("families"))  # equal for equal texts
    each = stage(texts.select("sha", "families", F.explode(F.array_distinct("found")).alias("m")).select("sha", F.explode(_entities(c("m"), c("families"))).alias("e")).select("sha", "e.*").distinct(), "entities")
    told = lambda g: F.bool_or(c("gender") == g)
    distinct = each.groupBy("kind", "value").agg(F.when(told("m") & ~told("f"), "m").when(told("f") & ~told("m"), "f").otherwise("n").alias("gender"))
    known = surrogates(stage(distinct, "distinct"), key)
    maps = each.select("sha", "kind", "value").distinct().join(known, ["kind", "value"]).groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "kind", "value"), "surrogate"))).alias("told"))
    say = lambda m: F.transform(_entities(m, c("families")), lambda e: F.element_at(c("told"), F.concat_ws("\x01", e["kind"], e["value"])))
    said = having.join(maps, "sha").select("row", "found", "pattern", F.transform("found", say).alias("said"))
    parts = F.when(c("pattern").isNull(), F.split(body, ANY, -1)).otherwise(F.split(body, c("pattern"), F.lit(-1)))
    woven = said.select("row", parts.alias("parts"), F.zip_with("found", "said", _write).alias("new"), F.transform(F.filter("found", lambda m: m["valid"]), lambda m: m["kind"]).alias("kinds"))
    whole = F.array_join(F.zip_with("parts", "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return without.unionByName(woven.select("row", whole.alias("text"), "kinds"))


def decisions(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the new text, the number of mentions and their kinds."""
    kinds = F.array_join(F.array_sort(F.array_distinct("kinds")), ",")
    return replace(docs, key).select(F.col("row.doc_id").alias("doc_id"), "text", F.size("kinds").cast("long").alias("n_entities"), kinds.alias("kinds"))


def with_surrogates(docs: DataFrame, key: str, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the text replaced (and its length column, if it has one)."""
    out = replace(docs, key, text)
    new = {text: F.col("text")} | ({length: F.length("text").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
