"""Planned entries, and how replies of a language model are read as plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tomewright.functions import text

PLAN_ORDER = "struct<n:bigint,key:string>"


@dataclass(frozen=True)
class Plans:
    """Entries to write, and the files each of them covers.

    plans:   plan_id, plan_order, filename, title, category, brief, n_sources
    sources: plan_id, filename, pos, path, lines        (in the order of pos, then path)
    """

    plans: DataFrame
    sources: DataFrame


def _items(json: Column) -> Column:
    """Array of the objects in a JSON array, each as its JSON text; null if it is none."""
    return F.when(F.substring(text.trim(json), 1, 1) == "[",
                  F.from_json(json, "array<string>"))


def parse_plans(replies: DataFrame, reply_id: str = "response_id", reply: str = "text") -> DataFrame:
    """Rows ``reply_id, pos, filename, title, category, source_files, brief`` of model replies.

    A reply is a JSON array of objects, bare, fenced as code, or with prose around it. An object
    without a file name or sources is skipped; other missing fields get defaults. A reply that is
    valid JSON but no array, or not readable at all, gives no rows.
    """
    trimmed = text.trim(F.col(reply))
    unfenced = F.when(
        F.startswith(trimmed, F.lit("```")),
        text.replace_all(text.replace_all(trimmed, r"^```(?:json)?\s*\n?", ""),
                         r"\n?```\s*$", "")).otherwise(trimmed)
    whole = F.try_parse_json(F.col("__reply")).isNotNull()
    inner = text.first_match(F.col("__reply"), r"\[[\s\S]*\]", 0)
    array = F.when(whole, F.col("__reply")).when(F.try_parse_json(inner).isNotNull(), inner)
    rows = (replies.select(F.col(reply_id), unfenced.alias("__reply"))
            .select(reply_id, whole.alias("__strict"), array.alias("__array"))
            .select(reply_id, "__strict", F.posexplode(_items(F.col("__array")))
                    .alias("pos", "item")))
    item = F.try_parse_json("item")
    rows = rows.select(reply_id, "pos", "__strict", "item", *[
        F.try_variant_get(item, f"$.{k}", "variant").alias(f"__{k}") for k in (
            "filename", "title", "category", "sourceFiles", "brief", "description")])
    listed = _kind("__sourceFiles").startswith("ARRAY")
    # One entry that is null spoils its whole reply; so does, in an array that had prose around
    # it, one whose sources are no list.
    spoiled = F.col("item").isNull() | (F.col("item") == "null") | (
        ~F.col("__strict") & _given("__sourceFiles").isNotNull() & ~listed)
    parsed = rows.withColumn("__spoiled", F.coalesce(spoiled, F.lit(False))).withColumn(
        "__listed", listed)
    bad = parsed.where(F.col("__spoiled")).select(reply_id).distinct()
    ok = parsed.join(bad, reply_id, "left_anti").where(
        _given("__filename").isNotNull() & F.col("__listed"))
    return ok.select(
        reply_id, "pos", _given("__filename").alias("filename"),
        F.coalesce(_given("__title"), _given("__filename")).alias("title"),
        F.coalesce(_given("__category"), F.lit("general")).alias("category"),
        F.transform(_members(F.col("__sourceFiles")), _shown).alias("source_files"),
        F.coalesce(_given("__brief"), _given("__description"), F.lit("")).alias("brief"))


def _kind(value: Column | str) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _members(value: Column) -> Column:
    """The members of a JSON array; null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _shown(value: Column) -> Column:
    """A JSON value as the text that a script makes of it."""
    kind = _kind(value)
    text_of = value.cast("string")
    whole = F.regexp_replace(text_of, r"\.0+$", "")
    return (F.when(kind == "VOID", F.lit("null"))
            .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
            .when(kind.startswith("ARRAY"), F.array_join(F.transform(
                _members(value), lambda v: F.coalesce(v.cast("string"), F.lit(""))),
                ","))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), whole).otherwise(text_of))


def _given(name: str) -> Column:
    """A member as text, or null where it is missing, null, false, zero or empty."""
    value, kind = F.col(name), _kind(name)
    shown = _shown(value)
    empty = ((kind == "VOID") | (kind.isin("STRING") & (shown == ""))
             | ((kind == "BOOLEAN") & (shown == "false"))
             | ((kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & (shown == "0")))
    return F.when(~empty, shown)


def is_safe_filename(filename: Column) -> Column:
    """An entry is a file of the knowledge base folder: no separators, no way out of it."""
    return ~F.contains(filename, F.lit("/")) & ~F.contains(filename, F.lit("\\")) & (
        ~filename.isin("", ".", ".."))


def plans_from_rows(rows: DataFrame, reply_id: str = "response_id") -> Plans:
    """``parse_plans`` rows as plans; names that would leave the folder are rejected."""
    safe = rows.where(is_safe_filename(F.col("filename")))
    plan_id = F.concat_ws("#", F.col(reply_id).cast("string"), F.col("pos").cast("string"))
    place = F.lpad(F.col("pos").cast("string"), 10, "0")
    if isinstance(rows.schema[reply_id].dataType, IntegralType):
        order = F.struct(F.col(reply_id).cast("long").alias("n"), place.alias("key"))
    else:  # the character before the place sorts before all that an id may go on with
        order = F.struct(F.lit(0).cast("long").alias("n"), F.concat_ws(
            "\u0000", F.col(reply_id).cast("string"), place).alias("key"))
    plans = safe.select(plan_id.alias("plan_id"), order.alias("plan_order"), "filename", "title",
                        "category", "brief",
                        F.size("source_files").cast("long").alias("n_sources"))
    sources = safe.select(plan_id.alias("plan_id"), "filename", F.posexplode("source_files")
                          .alias("pos", "path")).select(
        "plan_id", "filename", F.col("pos").cast("long").alias("pos"), "path",
        F.lit(None).cast("int").alias("lines"))
    return Plans(plans, sources)


def shown_lines() -> Column:
    """Line count of a file as entries show it: unknown for an empty one."""
    return F.when(F.col("size") > 0, F.col("lines"))


def with_line_counts(plans: Plans, files: DataFrame) -> Plans:
    """Line counts for sources that name their files only by path."""
    counts = files.select("path", shown_lines().alias("__lines"))
    sources = (plans.sources.join(counts, "path", "left")
               .select("plan_id", "filename", "pos", "path", F.coalesce("lines", "__lines").alias("lines")))
    return Plans(plans.plans, sources)


def choose_plans(model: Plans, static: Plans) -> Plans:
    """The model's plans, or the static ones where the model gave none."""
    return static if model.plans.isEmpty() else model
