"""Redaction of structured values by the names of their keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StringType, StructType

from tomewright import constants as K

REDACTED = "[REDACTED]"


def redact_map(c: Column) -> Column:
    """A ``map<string,string>`` with the values of secret keys replaced."""
    return F.transform_values(c, lambda k, v: F.when(
        F.lower(k).isin(K.SECRET_KEYS) & (F.length(v) > 0), F.lit(REDACTED)).otherwise(v))


def redact_typed(c: Column, dtype: DataType) -> Column:
    """The same for structs, and maps, nested in any way but inside arrays."""
    if isinstance(dtype, StructType):
        fields = []
        for f in dtype.fields:
            value = c.getField(f.name)
            if isinstance(f.dataType, StringType) and f.name.lower() in K.SECRET_KEYS:
                value = F.when(F.length(value) > 0, F.lit(REDACTED)).otherwise(value)
            else:
                value = redact_typed(value, f.dataType)
            fields.append(value.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, MapType) and isinstance(dtype.keyType, StringType):
        if isinstance(dtype.valueType, StringType):
            return redact_map(c)
        return F.transform_values(c, lambda _, v: redact_typed(v, dtype.valueType))
    return c


def _redact_value(value):
    if not isinstance(value, dict):
        return value
    return {k: REDACTED if k.lower() in K.SECRET_KEYS and isinstance(v, str) and v
            else _redact_value(v) for k, v in value.items()}


def _redact_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_redact_value(json.loads(text)), ensure_ascii=False,
                          separators=(",", ":"))
    except ValueError:
        return text


@F.pandas_udf(StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """JSON objects of any shape; the schema of each row may differ, so this is an Arrow UDF."""
    return texts.map(_redact_text)
