"""Secret redaction as column expressions.

The 23 rewrites are folded over the text in order, each reading what the one before it left. All
three results (text, count, names) come out of the fold as one struct, so asking for more than one
of them does not run a regular expression twice.

A rewrite can only fire on a text that holds one of a few literals (``AKIA``, ``jdbc:`` ...).
Those literals are looked for once, in the text as it came in, and a regular expression runs only
on texts that passed its test. No rewrite can put another rewrite's literal into a text that did
not hold it before, so testing the incoming text is enough.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import constants as K
from tomewright.functions.paths import basename
from tomewright.functions.regex import jvm
from tomewright.functions.text import let, matches

# What a text must hold, in any letter case, before a pattern is tried.
_NEEDS: dict[str, list[str]] = {
    "password-assignment": ["pass", "pwd"],
    "secret-assignment": ["secret"],
    "token-assignment": ["key", "token", "secret"],
    "credentials-url": [":/"],
    "bearer-token": ["auth"],
    "aws-access-key": ["akia"],
    "github-token": ["ghp_", "ghs_"],
    "github-oauth": ["github_pat_"],
    "slack-token": ["xox"],
    "stripe-key": ["k_live_"],
    "stripe-publishable": ["k_live_"],
    "google-api-key": ["aiza"],
    "firebase-key": ["aiza"],
    "mongodb-connection": [":/"],
    "postgres-connection": [":/"],
    "mysql-connection": [":/"],
    "redis-connection": [":/"],
    "jdbc-connection": ["jdbc:"],
    "private-key-block": ["-----begin"],
    "ssh-private-key": ["-----begin"],
    "env-var-secret": ["pass", "secret", "key", "token", "_url", "auth"],
}
# Patterns without a literal get a cheap necessary shape instead.
_NEEDS_SHAPE: dict[str, str] = {
    "aws-secret-key": "(?<![!-~])[!-~]{40}",
    "heroku-key": "-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-",
}


# How a match begins. Tested first at each place, this spares most places the dearer test for a
# word boundary that these patterns start with; it does not change what they match.
_BEGINS: dict[str, str] = {
    "password-assignment": "[Pp]",
    "secret-assignment": "[Ss]",
    "token-assignment": "[AaPp]",
    "bearer-token": "[Aa]",
    "aws-access-key": "A",
    "aws-secret-key": "[A-Za-z0-9/+=]{40}",
    "github-token": "g",
    "github-oauth": "g",
    "slack-token": "x",
    "stripe-key": "s",
    "stripe-publishable": "p",
    "google-api-key": "A",
    "firebase-key": "A",
    "heroku-key": "[0-9A-Fa-f]{8}-",
}


def _regex(name: str, pattern: str, flags: str) -> str:
    begins = f"(?={_BEGINS[name]})" if name in _BEGINS else ""
    return begins + jvm(pattern, flags)


_RULES = [
    {"name": name, "regex": _regex(name, pattern, flags), "replacement": replacement,
     "needs": _NEEDS.get(name, [])}
    for name, pattern, flags, replacement in K.SECRET_PATTERNS]
_RULES_TYPE = "array<struct<name:string,regex:string,replacement:string,needs:array<string>>>"


def redaction(c: Column, names: list[str] | None = None) -> Column:
    """``struct(content, redactions, triggered)`` of a text after all rewrites, or those named.

    ``redactions`` counts the secrets replaced and ``triggered`` names the patterns that fired,
    in firing order. A match that is rewritten to itself counts for nothing.
    """
    def may_fire(rule: Column, low: Column) -> Column:
        test = F.exists(rule.needs, lambda w: F.contains(low, w))
        for name, shape in _NEEDS_SHAPE.items():
            test = test | ((rule["name"] == name) & c.rlike(shape))
        return test

    def fire(state: Column, rule: Column) -> Column:
        return let(
            F.regexp_replace(state.content, rule.regex, rule.replacement),
            lambda after: F.when(after != state.content, F.struct(
                after.alias("content"),
                (state.redactions + F.regexp_count(state.content, rule.regex)).alias("redactions"),
                F.array_append(state.triggered, rule["name"]).alias("triggered"),
            )).otherwise(state))

    start = F.struct(c.alias("content"), F.lit(0).alias("redactions"),
                     F.array().cast("array<string>").alias("triggered"))
    # A constant: the optimizer reads the JSON once, not the tasks.
    wanted = [r for r in _RULES if names is None or r["name"] in names]
    rules = F.from_json(F.lit(json.dumps(wanted)), _RULES_TYPE)
    possible = let(F.lower(c), lambda low: F.filter(rules, lambda r: may_fire(r, low)))
    return F.when(c.isNotNull(), F.aggregate(possible, start, fire))


def redact(df: DataFrame, col: str, *, out: str | None = None, count: str | None = None,
           triggered: str | None = None) -> DataFrame:
    """Replace ``col`` (or add ``out``) with its redacted text, and add the named extras."""
    result = F.col("__redaction")
    target = out or col
    done = df.withColumn("__redaction", redaction(F.col(col)))
    columns = [result.content.alias(c) if c == target else F.col(c) for c in df.columns]
    if target not in df.columns:
        columns.append(result.content.alias(target))
    if count:
        columns.append(result.redactions.alias(count))
    if triggered:
        columns.append(result.triggered.alias(triggered))
    return done.select(*columns)


def is_sensitive_path(path: Column) -> Column:
    """True for files whose name alone says that they hold secrets."""
    name = basename(path)
    by_pattern = "|".join(f"(?:{jvm(p, 'i').removeprefix('(?i)')})"
                          for p in K.SENSITIVE_NAME_PATTERNS)
    return (name.isin(K.SENSITIVE_FILENAMES) | path.isin(K.SENSITIVE_FILENAMES)
            | name.rlike("(?i)" + by_pattern))


def sanitize_file(df: DataFrame, path: str, col: str) -> DataFrame:
    """Redacted text, or null for a file whose name is sensitive."""
    return redact(df.withColumn(col, F.when(~is_sensitive_path(F.col(path)), F.col(col))), col)


def sensitivity_score(c: Column) -> Column:
    """How likely a text is to hold real secrets; a heuristic, unrelated to ``redact``."""
    low = F.lower(c)
    parts = [F.when(matches(c, p, "i"), F.lit(s)).otherwise(F.lit(0.0))
             for p, s in K.SCORE_PATTERNS]
    parts += [F.when(F.contains(low, F.lit(w)), F.lit(s)).otherwise(F.lit(0.0))
              for w, s in K.SCORE_WORDS]
    return reduce(lambda a, b: a + b, parts)


def likely_contains_secrets(c: Column) -> Column:
    return sensitivity_score(c) >= K.SECRET_SCORE_THRESHOLD


def redaction_report(df: DataFrame, col: str) -> DataFrame:
    """Rows touched per pattern over a whole corpus, and the secrets in those rows."""
    hits = redact(df.select(col), col, count="redactions", triggered="triggered")
    # The outer form keeps the optimizer from redacting once more to test for empty lists.
    return (hits.select(F.explode_outer("triggered").alias("pattern"), "redactions")
            .where("pattern IS NOT NULL").groupBy("pattern")
            .agg(F.count("*").alias("rows_hit"),
                 F.sum("redactions").alias("secrets_in_rows")))
