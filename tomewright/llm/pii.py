"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern and replaced by surrogates of their own kind. A surrogate depends
on a key, the kind and the entity's canonical form (an address in lower case, the digits of a
number), so all mentions of an entity in all documents get the same one, each in the format of the
mention: separators, case and script of every character stay, a card keeps its first digit and a
right check digit, an IP address has valid parts, a phone number its country code, an e-mail
address its last label, and a name gets a given name of the gender that its title says.

Entities of a kind must stay distinct: surrogates are worked out for the table of distinct entities,
and those that meet another surrogate, or an entity that occurs, are drawn again until none does.

Texts without entities never leave their partition. Of the others equal texts are worked out once:
mentions are joined with the surrogates, gathered by text, and joined back by the text's hash.

Cases: null stays null and empty empty, without entities. A mention counts each time it occurs.
Equal rows give equal rows. All columns are kept; ``n_entities`` and ``entity_types`` are added,
replacing columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.frames import internal, written

#: A title, and the gender that it says (``n``: none).
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Mme": "f",
    "госпожа": "f", "Dr": "n", "Prof": "n",
}

# Given names by script and gender, and syllables of family names.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karel Leon Marco Nils "
                    "Oscar Paul Ralf Simon Tomas Viktor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Frida Greta Helena Irene Julia Klara Laura Maria "
                    "Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег "
                       "Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга "
                       "Полина Софья".split(),
}
SYLLABLES = {
    "latin": "bar bel dan dor fal gar hol kan kel lam lin mar mor nor pal ran ros sel tar tol ven "
             "vor wal zan".split(),
    "cyrillic": "бар бел дан дор гал кал кор лам лин мар мор нор пал ран рос сел тар тол вен "
                "зан".split(),
}

_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
_SECRET = (r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?[=:] ?[\"']?")
# No quantifier can be given back and tried again over a long run of characters: runs are
# possessive and begin only where nothing of their kind stands before.
_KINDS = {
    "secret": rf"(?<![\p{{L}}\p{{N}}]){_SECRET}[^\s\"',;]{{6,}}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|"
           r"xox[abprs]-[A-Za-z0-9-]{10,}+|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})"
           r"(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}"
          r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]?\d{6}[ -]?\d{5})"
            r"(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
            r"(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?:(?<![\p{L}\p{N}.])\+\d{1,3}[ .-]?)?(?<![\p{L}\p{N}.])\(\d{2,4}\)[ .-]?"
             r"\d{3}[ .-]?\d{4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}-])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
}
PATTERN = "|".join(f"(?:{p})" for p in _KINDS.values())
# What every entity holds at least one of, in tests that are quick where there is nothing to find.
_MARKS = ["@", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox",
          *(f"{title}{dot} " for title in TITLES for dot in ("", "."))]
_NUMBERS = r"\d{3}|\d\.\d|[A-Z]{2}\d|\+\d"
_HEXADECIMAL = r"[0-9a-f]{32}"
_NAMED = r"(?i:password|passwd|pwd|secret|token|key)"

_MAX_ROUNDS = 40


def mentions(text: str | Column) -> Column:
    """All mentions in a text, in order."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    hint = text.rlike(_NUMBERS) | text.rlike(_HEXADECIMAL) | (
        (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(_NAMED))
    for mark in _MARKS:
        hint = hint | F.contains(text, F.lit(mark))
    none = F.array().cast("array<string>")
    return F.when(hint, found).otherwise(none)


def _kind(mention: Column) -> Column:
    """The kind of a mention: the first whose pattern it is."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_KINDS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _kept_prefix(kind: Column, mention: Column) -> Column:
    """What stays in front: the name of a secret, a title, a country code, a key's first letters."""
    return (F.when(kind == "secret", F.regexp_extract(mention, f"^{_SECRET}", 0))
            .when(kind == "person", F.regexp_extract(mention, f"^{_TITLE}", 0))
            .when(kind == "phone", F.regexp_extract(mention, r"^\+\d{1,3}(?=[ .(-])", 0))
            .when(kind == "key", F.regexp_extract(mention, r"^(?:AKIA|gh[pousr]_|xox[abprs]-)", 0))
            .when(kind == "iban", F.substring(mention, 1, 2))
            .otherwise(F.lit("")))


def _kept_suffix(kind: Column, mention: Column) -> Column:
    return F.when(kind == "email", F.regexp_extract(mention, r"\.\p{L}+$", 0)).otherwise(F.lit(""))


def _canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity share."""
    body = F.expr("substring(mention, length(prefix) + 1)")
    return (F.when(kind == "email", F.lower(mention))
            .when(kind.isin("card", "ssn", "phone"), _digits(mention))
            .when(kind == "iban", F.regexp_replace(mention, " ", ""))
            .when(kind.isin("secret", "person"), body)
            .otherwise(mention))


def describe(found: DataFrame) -> DataFrame:
    """Rows with a ``mention`` and what replacing it needs."""
    return (found.withColumn("kind", _kind(F.col("mention")))
            .withColumn("prefix", _kept_prefix(F.col("kind"), F.col("mention")))
            .withColumn("suffix", _kept_suffix(F.col("kind"), F.col("mention")))
            .withColumn("canonical", _canonical(F.col("kind"), F.col("mention"))))


# The letters that stand for letters of a script, in capitals and small.
_LETTERS = {
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
_HEX = "0123456789abcdef"


def _draws(key: str) -> Column:
    """Keyed numbers, three hexadecimal digits each, as many as a mention has characters."""
    seed = F.concat_ws("\u0001", F.lit(key), "kind", "canonical", F.col("attempt").cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.length("mention") / 20).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws(
        "\u0001", seed, b.cast("string")).cast("binary"), 256).substr(1, 63)), "")


def _draw(place: Column, choices: int) -> Column:
    """The number for a place of the surrogate, below ``choices``."""
    part = F.col("draws").substr(place * 3 + 1, F.lit(3))
    return F.pmod(F.conv(part, 16, 10).cast("int"), F.lit(choices))


_SPELLED = r"[\p{L}\p{N}]"


def _spelled() -> Column:
    """``body`` with each letter or digit replaced by another of its script and case.

    The n-th letter or digit of an entity gets the same draw in all its formats. Letters, the gaps
    between them and the draws are arrays, so the work is in proportion to the length.
    """
    def one(c: Column, place: Column) -> Column:
        number = F.conv(F.element_at("numbers", place + 1), 16, 10).cast("int")

        def letter(letters: str) -> Column:
            return F.lit(letters).substr(F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))

        # No group of a phone number begins with 0.
        first = (F.col("kind") == "phone") & ((place == 0) | (F.element_at("gaps", place + 1) != ""))
        out = (F.when((F.col("kind") == "card") & (place == 0), c)
               .when(F.col("is_hex") & c.rlike("[0-9a-f]"), letter(_HEX))
               .when(c.rlike(r"\p{Nd}") & first, letter("123456789"))
               .when(c.rlike(r"\p{Nd}"), letter("0123456789")))
        for script, letters in _LETTERS.items():
            out = out.when(c.rlike(script), letter(letters))
        return out.otherwise(c)

    return F.array_join(F.zip_with("gaps", F.array_append(F.transform("letters", one), F.lit("")),
                                   lambda gap, c: F.concat(gap, c)), "")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a card number right, from the digits before it."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0),
                        lambda a, b: a + b)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _without_last(text: Column) -> Column:
    return text.substr(F.lit(1), F.length(text) - 1)


def _name() -> Column:
    """A name of as many words; draws after a collision have longer family names."""
    gender = F.when(_draw(F.lit(0), 2) == 0, F.lit("m")).otherwise(F.lit("f"))
    for word, g in TITLES.items():
        if g != "n":
            gender = F.when(F.col("prefix").startswith(word), F.lit(g)).otherwise(gender)

    def pick(place: Column, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), _draw(place, len(values)) + 1)

    def written_in(script: str) -> Column:
        given = F.when(gender == "m", pick(F.lit(1), GIVEN[script, "m"])).otherwise(
            pick(F.lit(1), GIVEN[script, "f"]))
        family = F.initcap(F.array_join(F.transform(
            F.sequence(F.lit(2), F.least(4 + F.col("attempt"), F.lit(18))),
            lambda k: pick(k, SYLLABLES[script])), ""))
        return F.when(F.col("body").contains(" "), F.concat_ws(" ", given, family)).otherwise(
            family)

    return F.when(F.col("body").rlike(r"^\p{IsCyrillic}"), written_in("cyrillic")).otherwise(
        written_in("latin"))


def with_surrogate(mentions_of: DataFrame, key: str, name: str) -> DataFrame:
    """The replacement of each ``mention``, from the columns of ``describe`` and ``attempt``.

    It is worked out in three written steps, so that no step repeats the work of the one before.
    """
    kind, body = F.col("kind"), F.col("body")
    drawn = written(mentions_of.withColumn("draws", _draws(key)).withColumn("body", F.expr(
        "substring(mention, length(prefix) + 1, "
        "length(mention) - length(prefix) - length(suffix))")), "pii-draws")
    spelled = written(
        drawn.withColumn("letters", F.regexp_extract_all(body, F.lit(_SPELLED), F.lit(0)))
        .withColumn("gaps", F.split(body, _SPELLED, -1))
        .withColumn("numbers", F.regexp_extract_all("draws", F.lit("..."), F.lit(0)))
        .withColumn("is_hex", kind.isin("secret", "key") & body.rlike("^[0-9a-f]+$"))
        .withColumn("valid", (kind == "card") & (_check_digit(_without_last(
            _digits(body))) == F.substring(body, -1, 1))), "pii-characters")
    plain = written(spelled.withColumn("plain", _spelled()).drop("letters", "gaps", "numbers"),
                    "pii-plain")
    parts = F.array_join(F.transform(F.split(body, r"\."), lambda _, i: (
        _draw(i, 254) + 1).cast("string")), ".")
    card = F.concat(_without_last(F.col("plain")), _check_digit(_without_last(
        _digits(F.col("plain")))))
    new = (F.when(kind == "ip", parts).when(F.col("valid"), card).when(kind == "person", _name())
           .otherwise(F.col("plain")))
    return plain.withColumn(name, F.concat("prefix", new, "suffix")).select(
        *mentions_of.columns, name)


def _settle(kinds: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, canonical, attempt), such that surrogates are distinct too."""
    fields = ("kind", "canonical", "mention", "prefix", "suffix")
    state = written(kinds.groupBy("kind", "canonical").agg(
        F.min(F.struct("mention", "prefix", "suffix")).alias("m"))
        .select("kind", "canonical", "m.*", F.lit(0).alias("attempt")), "pii-entities")
    for _ in range(_MAX_ROUNDS):
        drawn = written(with_surrogate(state, key, "new"), "pii-drawn")
        # A surrogate is the entity that a reader would take it for.
        read = describe(drawn.select(F.col("new").alias("mention"), *[
            F.col(c).alias(f"old_{c}") for c in (*fields, "attempt")]))
        made = read.select(F.col("canonical").alias("new"), *[
            F.col(f"old_{c}").alias(c) for c in (*fields, "attempt")])
        first = made.groupBy("kind", "new").agg(F.min(F.struct(
            -F.col("attempt"), "canonical")).alias("keeps"))
        taken = state.select("kind", F.col("canonical").alias("new"), F.lit(1).alias("real"))
        bad = F.col("real").isNotNull() | (F.col("keeps.canonical") != F.col("canonical"))
        judged = written(made.join(first, ["kind", "new"]).join(taken, ["kind", "new"], "left")
                         .select(*fields, "attempt", bad.alias("bad")), "pii-judged")
        if judged.where("bad").isEmpty():
            return state
        state = judged.select(*fields, (F.col("attempt") + F.col("bad").cast("int")).alias(
            "attempt"))
    raise RuntimeError("surrogates of some kind are too few for its entities")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, ``n_entities`` and ``entity_types``."""
    found, digest = internal(docs, "found"), internal(docs, "digest")
    order = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    searched = docs.select(*order).withColumn(found, mentions(text))
    none = F.array().cast("array<string>")
    clean = (searched.where(F.coalesce(F.size(found), F.lit(0)) <= 0)
             .select(*order, F.lit(0).cast("long").alias("n_entities"),
                     none.alias("entity_types")))
    with_any = (searched.where(F.size(found) > 0)
                .withColumn(digest, F.sha2(F.col(text).cast("binary"), 256)))
    texts = written(with_any.groupBy(F.col(digest).alias("digest")).agg(
        F.first(found).alias("found")), "pii-mentions")
    each = texts.select("digest", F.posexplode("found").alias("at", "mention"))
    kinds = written(describe(each.select("mention").distinct()), "pii-kinds")
    settled = _settle(kinds, key).select("kind", "canonical", "attempt")
    replaced = with_surrogate(kinds.join(settled, ["kind", "canonical"]), key, "surrogate")
    replaced = replaced.select("mention", "kind", "surrogate")
    by_text = (each.join(replaced, "mention").groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("at", "surrogate", "kind"))).alias("got")))
    pieces = F.split(F.col(text), PATTERN, -1)
    put = F.zip_with(F.col("got.surrogate"), F.slice(pieces, 2, F.size("got")),
                     lambda s, p: F.concat(s, p))
    dirty = (with_any.join(by_text, with_any[digest] == by_text["digest"])
             .withColumn(text, F.concat(F.element_at(pieces, 1), F.array_join(put, "")))
             .select(*order, F.size("got").cast("long").alias("n_entities"),
                     F.array_sort(F.array_distinct(F.col("got.kind"))).alias("entity_types")))
    return clean.unionByName(dirty)
