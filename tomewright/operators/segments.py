"""Long texts as ordered blocks, and work on them that gives what the whole text would.

A text that is too long for one row is a few rows of ``block`` numbers. Where a block ends is chance,
so a match of a pattern may lie over the border of two blocks, or over many blocks. ``recut`` moves
the borders to places over which a pattern cannot match: the part of each block in front of its first
such place goes to the block before. ``drop_between`` takes out what lies between two marks, however
many blocks apart: each block is a function of two states (inside or outside), and the functions are
put together in order by running sums over one narrow row per block.

Most texts are short. ``redact_texts`` holds the blocks of such a text as a list in one row and takes
the same steps there, so that one shuffle brings its pieces together and no other follows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.functions import secrets
from tomewright.functions.frontmatter import END
from tomewright.functions.regex import EOL, WS, jvm
from tomewright.functions.text import let
from tomewright.operators.ordering import freeze, with_ordinal

BLOCK_PIECES = 4096
BLOCK_CHARS = 1 << 20
# The blocks of a text of up to so many characters, in so many pieces, are held in one row.
TEXT_CHARS = 1 << 20
TEXT_PIECES = 1 << 16
FIRST = 1  # the number that ``recut`` gives to the first block that has text
_SHIFT = 32  # a block's number: which pieces above, which of their characters below


def blocks(pieces: DataFrame, key: str, order: list[str], text: str = "text", *,
           max_pieces: int | None = None, max_chars: int | None = None) -> DataFrame:
    """``key, block, text``: the pieces of each key joined in order, some of them in a block.

    A block holds at most ``max_pieces`` pieces, and pieces that begin in the same ``max_chars``
    characters. ``order`` must tell the pieces of a key apart.
    """
    max_pieces, max_chars = max_pieces or BLOCK_PIECES, max_chars or BLOCK_CHARS
    placed = with_ordinal(pieces.select(key, *order, F.col(text).alias("text")), key, *order,
                          name="__n").withColumn("__part", F.floor(F.col("__n") / max_pieces))
    before = Window.partitionBy(key, "__part").orderBy("__n").rowsBetween(
        Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    ordered = F.sort_array(F.collect_list(F.struct("__n", "text")))
    return (placed.withColumn("__sub", F.floor(begin / max_chars))
            .groupBy(key, (F.shiftleft("__part", _SHIFT) + F.col("__sub")).alias("block"))
            .agg(F.array_join(F.transform(ordered, lambda x: x.text), "").alias("text")))


def recut(df: DataFrame, key: str, cut: str) -> DataFrame:
    """``key, block, text`` with borders moved to where ``cut`` says; ``block`` numbers anew.

    ``cut`` is a pattern of a whole beginning of a block that ends at a good place. Blocks without
    one are joined with what is before them.
    """
    df = freeze(df.withColumn("__head", F.length(F.regexp_extract("text", cut, 0))))
    ahead = Window.partitionBy(key).orderBy("block")
    # Narrow rows: a number for each block. The beginning of a text is a good place.
    first = F.lag("block").over(ahead).isNull()
    narrow = (df.select(key, "block", "__head").withColumn("__first", first)
              .withColumn("__unit", F.sum(F.when(F.col("__first") | (F.col("__head") > 0), 1)
                                          .otherwise(0)).over(ahead)).drop("__head"))
    parts = df.join(narrow, [key, "block"]).withColumn("__cut", F.when(
        F.col("__first") | (F.col("__head") == 0), 0).otherwise(F.col("__head")))
    rows = parts.select(key, F.explode(F.array(
        F.struct((F.col("__unit") - 1).alias("unit"), F.col("block").alias("at"),
                 F.substring("text", F.lit(1), F.col("__cut")).alias("text")),
        F.struct(F.col("__unit").alias("unit"), F.col("block").alias("at"),
                 F.substring("text", F.col("__cut") + 1, F.lit(END)).alias("text")))).alias("p"))
    return (rows.where("p.text <> ''").groupBy(key, F.col("p.unit").alias("block"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(
                F.struct("p.at", "p.text"))), lambda x: x.text), "").alias("text")))


#: A beginning that ends behind a line end.
LINES = r"\A(?s:.)*?\n"

# Words after which a secret pattern goes on over white space.
_GOES_ON = ["bearer", "basic", "token", "begin", "rsa", "openssh", "private", "end"]
_ENV_NAMES = re.search(r"\(([A-Z_|]+)\)", {n: p for n, p, _, _ in K.SECRET_PATTERNS}[
    "env-var-secret"])[1]
# A beginning that ends behind the white space at the end of a line, such that no secret pattern
# matches over that place. Patterns go over white space only next to a colon or an equals sign, after
# the words above, and from the white space in front of an environment variable; and over all that
# a key block encloses, which is not for ``recut`` to see. A word or name must stand in the block whole
# to be seen, so there are some characters on both sides. The line end is looked for first: the words
# are dear to look back for and would be at every character. Before all, a place within a word is passed
# over by one cheap test: no white space is between "!" and "~".
_NO_SECRET = (
    rf"\A(?s:.){{12,}}?(?!(?s:.)[!-~])[^{WS}:=](?=[{WS}&&[^{EOL}]]*+[{EOL}])"
    rf"(?<!(?i:{'|'.join(_GOES_ON)}))[{WS}]++(?=[^{WS}:=])(?!(?i:{_ENV_NAMES}))(?=(?s:.){{20}})")
_KEYS = ["private-key-block", "ssh-private-key"]
_DASHES = "-----"  # both marks of a key block begin so
_LAST = "env-var-secret"


def redact_blocks(df: DataFrame, key: str) -> DataFrame:
    """``key, block, text`` redacted as the whole text of each key would be.

    Patterns are applied in their order: those in front of the key blocks, key blocks of each kind,
    and the one behind them. Before each of these steps borders are moved to where its patterns
    cannot match over them. Text without such a place stays together, however long it is.
    """
    names = [n for n, _, _, _ in K.SECRET_PATTERNS]
    first = [n for n in names[:names.index(_KEYS[0])]]
    assert names == [*first, *_KEYS, _LAST]
    out = freeze(_redacted(recut(df, key, _NO_SECRET), first))
    for name in _KEYS:
        begin, end, gone = _key_marks(name)
        # Without a beginning or an end there is no block; what follows is then spared.
        if not out.where(F.col("text").rlike(begin)).isEmpty() and not out.where(
                F.col("text").rlike(end)).isEmpty():
            out = freeze(recut(drop_between(
                out, key, begin, end, gone, gone.split("[REDACTED]")[1], _DASHES), key, _NO_SECRET))
    return _redacted(out, [_LAST])


def long_texts(pieces: DataFrame, key: str, text: str = "text", *,
               max_chars: int = TEXT_CHARS) -> DataFrame:
    """Keys of texts that are too long for one row; each has a good part of all characters or pieces."""
    sizes = pieces.groupBy(key).agg(F.sum(F.length(text)).alias("__chars"),
                                    F.count("*").alias("__pieces"))
    return freeze(sizes.where((F.col("__chars") > max_chars) | (F.col("__pieces") > TEXT_PIECES))
                  .select(key))


def redact_texts(pieces: DataFrame, key: str, order: list[str], *, max_pieces: int | None = None,
                 max_chars: int | None = None) -> DataFrame:
    """``key, block, text``: what ``redact_blocks`` gives for ``blocks`` of short texts, joined.

    Blocks hold as many pieces and go through the same steps, but the list of a text's blocks is one
    row, so all of a text must fit in one. As there, rows without a key are left out.
    """
    mark = f"\u0001{uuid.uuid4().hex}\u0001"  # of this call, so no text holds it
    names = [n for n, _, _, _ in K.SECRET_PATTERNS]
    of_key = F.sort_array(F.collect_list(F.struct(*order, "text")))
    rows = (pieces.where(F.col(key).isNotNull()).groupBy(key).agg(of_key.alias("__list"))
            .withColumn("__list", F.transform("__list", lambda x: F.coalesce(x.text, F.lit(""))))
            .withColumn("__list", _list_blocks(F.col("__list"), mark, max_pieces or BLOCK_PIECES,
                                               max_chars or BLOCK_CHARS)))
    rows = _redacted_list(rows.withColumn("__list", _list_recut(F.col("__list"), mark)),
                          names[:names.index(_KEYS[0])])
    for name in _KEYS:
        begin, end, gone = _key_marks(name)
        held = _list_holds(begin) & _list_holds(end)
        # Borders are between two marks of a key block, but never within one.
        kept = F.split(F.regexp_replace(F.array_join("__list", mark), _pair(begin, end), gone), mark)
        rows = rows.withColumn("__list", F.when(
            held, _list_recut(kept, mark)).otherwise(F.col("__list")))
    return _redacted_list(rows, [_LAST]).select(
        key, F.lit(FIRST).cast("long").alias("block"), F.array_join("__list", "").alias("text"))


def _list_blocks(texts: Column, mark: str, max_pieces: int, max_chars: int) -> Column:
    """The list of blocks of a text, of its list of pieces; see ``blocks``."""
    def by_chars(part: Column) -> Column:
        begins = F.aggregate(part, F.array(F.lit(0).cast("long")), lambda a, t: F.array_append(
            a, F.element_at(a, -1) + F.length(t)))
        return let(F.transform(begins, lambda n: F.floor(n / max_chars)), lambda sub: F.split(
            F.array_join(F.transform(part, lambda t, i: F.when(
                (i > 0) & (F.get(sub, i) != F.get(sub, i - 1)), F.concat(F.lit(mark), t)).otherwise(t)),
                ""), mark))

    starts = F.sequence(F.lit(1), F.size(texts), F.lit(max_pieces))
    return F.flatten(F.transform(starts, lambda n: let(F.slice(texts, n, max_pieces), lambda part: let(
        F.array_join(part, ""), lambda whole: F.when(F.length(whole) < max_chars, F.array(whole))
        .otherwise(by_chars(part))))))


def _list_recut(texts: Column, mark: str) -> Column:
    """The list of blocks of a text with borders moved to where no secret is; see ``recut``."""
    marked = F.transform(texts, lambda b, i: F.when(
        (i > 0) & _has_line_end(b), F.regexp_replace(b, _NO_SECRET, f"$0{mark}")).otherwise(b))
    return F.filter(F.split(F.array_join(marked, ""), mark), lambda b: b != "")


def _redacted_list(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("__list", F.transform(
        "__list", lambda b: secrets.redaction(b, names)["content"]))


def _list_holds(key_mark: str) -> Column:
    return F.exists("__list", lambda b: F.contains(b, F.lit(_DASHES)) & b.rlike(key_mark))


def _has_line_end(text: Column) -> Column:
    return (F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
            | F.contains(text, F.lit("\u2028")) | F.contains(text, F.lit("\u2029")))


def _key_marks(name: str) -> tuple[str, str, str]:
    """Patterns of the marks around a kind of key block, and what stands for all of it."""
    _, pattern, flags, gone = next(p for p in K.SECRET_PATTERNS if p[0] == name)
    assert pattern.startswith(_DASHES) and f"*?{_DASHES}" in pattern
    begin, end = (jvm(p, flags) for p in pattern.split(r"[\s\S]*?"))
    return begin, end, gone


def _pair(begin: str, end: str) -> str:
    return rf"{begin}(?s:.)*?{end}"


def _redacted(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("text", secrets.redaction(F.col("text"), names)["content"])


def drop_between(df: DataFrame, key: str, begin: str, end: str, gone: str,
                 an_end: str, held: str = "") -> DataFrame:
    """``key, block, text`` with ``gone`` for all from a ``begin`` to the next ``end``.

    ``an_end`` is a text that ``end`` matches; ``held`` is in both marks, and only blocks that hold it
    are searched for them. Neither mark may lie over the border of two blocks. A beginning without an
    end stays. ``df`` is read twice.
    """
    pair = _pair(begin, end)
    to_end = rf"\A(?s:.)*?{end}"

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, pair, "\u0000").rlike(begin)

    def where_held(value: Column, otherwise: Column, text: Column) -> Column:
        return F.when(F.contains(text, F.lit(held)), value).otherwise(otherwise)

    text, no = F.col("text"), F.lit(False)
    # What a block does to each state: how it ends if it begins outside, and inside.
    flags = freeze(df.select(
        key, "block", where_held(text.rlike(end), no, text).alias("ends"),
        where_held(opens(text), no, text).alias("outside"),
        where_held(F.when(text.rlike(end), opens(F.regexp_replace(text, to_end, "")))
                   .otherwise(True), F.lit(True), text).alias("inside")))
    order = Window.partitionBy(key).orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # The last block that ends alike from both states, and how often the state turned over since.
    turned = flags.withColumn("turns", F.sum((F.col("outside") & ~F.col("inside")).cast("long"))
                              .over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.when(F.col("outside") == F.col("inside"),
                  F.struct("block", F.col("outside").cast("long").alias("state"), "turns"))
    known = turned.withColumn("last", F.max(same).over(earlier)).withColumn(
        "before", F.coalesce(F.max("turns").over(earlier), F.lit(0)))
    state = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("before")
             - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    ends = F.when(F.col("ends"), F.col("block"))
    states = known.select(
        key, "block", "ends", "outside", "inside",
        (state & F.min(ends).over(order.rowsBetween(0, Window.unboundedFollowing)).isNotNull())
        .alias("within"),
        F.min(ends).over(order.rowsBetween(1, Window.unboundedFollowing)).isNotNull()
        .alias("will_end")).select(
        key, "block", "ends", "within",
        (F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")) & F.col("will_end"))
        .alias("stays"))
    kept = F.when(~F.col("within"), text).when(
        F.col("ends"), F.regexp_replace(text, to_end, "")).otherwise("")
    # The end of a later block stands behind what is open here.
    closed = F.when(F.col("stays") & ~(F.col("within") & ~F.col("ends")),
                    F.concat(kept, F.lit(an_end))).otherwise(kept)
    return df.join(states, [key, "block"]).withColumn("text", closed).select(
        key, "block", where_held(F.regexp_replace(text, pair, gone), text, text).alias("text"))
