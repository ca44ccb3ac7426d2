"""Facts about source files: one job over the corpus, one row per fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import paths
from tomewright.operators.facts import braces, comments, config, javascript, markdown, python
from tomewright.operators.facts.kinds import KINDS, Facts, no_facts

_JSON, _YAML, _TOML, _MD = [".json"], [".yaml", ".yml"], [".toml"], [".md"]


def family(extension: Column, language: Column) -> Column:
    """Which set of rules a file is read by."""
    return (F.when(extension.isin(_JSON), F.lit("json"))
            .when(extension.isin(_YAML), F.lit("yaml"))
            .when(extension.isin(_TOML), F.lit("toml"))
            .when(extension.isin(_MD), F.lit("markdown"))
            .when(language.isin("typescript", "javascript"), F.lit("script"))
            .when(language == "python", F.lit("python"))
            .otherwise(F.lit("other")))


def extract_facts(files: DataFrame) -> DataFrame:
    """``path, language, kind, ord, value`` from ``files(path, content)``.

    ``ord`` is the place of a fact among those of its kind in its file. The corpus is read once:
    each row goes through the rules of its own family only. All are column expressions but for
    JSON, which must keep the order of its keys, and scripts that nest very deep; their texts go
    through Arrow.
    """
    ext = paths.extension(F.col("path"))
    lang = paths.detect_language(ext)
    rows = files.select("path", lang.alias("language"), family(ext, lang).alias("family"),
                        paths.basename(F.col("path")).alias("name"), "content")
    content, fam = F.col("content"), F.col("family")
    rows = (rows
            .withColumn("__json", config.json_facts(
                F.when(fam == "json", F.struct("name", "content"))))
            .transform(braces.with_brace_facts, F.when(fam == "script", content), "__braces")
            .withColumn("__script", F.when(fam == "script", javascript.parsed(content)))
            .withColumn("__defs", F.when(fam == "python", python.documented_functions(content)))
            .withColumn("__about", comments.module_description(fam, content)))
    about = F.col("__about")
    found = (F.when(fam == "script", javascript.facts(
        content, about, F.col("__script"), F.col("__braces")))
             .when(fam == "python", python.facts(content, about, F.col("__defs")))
             .when(fam == "json", F.col("__json"))
             .when(fam == "yaml", config.yaml_facts(content))
             .when(fam == "toml", config.toml_facts(content))
             .when(fam == "markdown", markdown.facts(content))
             .otherwise(Facts(purpose=comments.first_sentence_or_none(about)).column()))
    by_kind = rows.select("path", "language", found.alias("f")).select(
        "path", "language", F.explode_outer(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.col(f"f.{k}").alias("values")) for k in KINDS]))
        .alias("k"))
    # The outer form keeps the optimizer from testing for empty lists first, which would compute
    # every fact twice.
    return by_kind.select("path", "language", "k.kind", F.posexplode_outer("k.values")
                          .alias("ord", "value")).where("ord IS NOT NULL")


__all__ = ["extract_facts", "family", "no_facts"]
