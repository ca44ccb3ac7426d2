"""Plain versions of the word rules, and documents with every odd case."""

import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, score double, ids string, n_words string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return ALNUM.findall(lower(text))


def spaced(text):
    return SPACED.findall(lower(text))


def odd_documents():
    """(doc_id, text): nulls, empty texts, a very long one, one giant word, repeated rows."""
    long = " ".join(f"word{i % 997} über{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, "x" * 300_000), (6, "Same Text é 漢"),
            (6, "Same Text é 漢"), (7, "same text É 漢"), (None, "no id here"), (8, "..."),
            (9, "　ideographic spaces　"), (10, "a"), (None, None)]


def frame(spark, rows):
    """The rows with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", 7.0, "kept", "kept") for i, t in rows], DOCS)
