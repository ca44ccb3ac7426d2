"""What is known about a file: one list of strings for each kind of fact."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tomewright import constants as K

KINDS = ["purpose", *K.FACT_CAPS]


def lists_type(names: list[str]) -> StructType:
    return StructType([StructField(n, ArrayType(StringType())) for n in names])


def strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def when_some(condition: Column, value: Column | str) -> Column:
    """One fact if the condition holds, otherwise none."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(condition, strings(value)).otherwise(strings())


def filled(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def code(c: Column | str) -> Column:
    return F.concat(F.lit("`"), F.lit(c) if isinstance(c, str) else c, F.lit("`"))


def listed(values: Column, limit: int) -> Column:
    return F.array_join(F.slice(values, 1, limit), ", ")


@dataclass
class Facts:
    """Columns for each kind; a kind's lists are appended to each other."""

    purpose: Column | None = None
    lists: dict[str, list[Column]] = field(default_factory=dict)

    def add(self, kind: str, *values: Column) -> Facts:
        self.lists.setdefault(kind, []).extend(values)
        return self

    def column(self) -> Column:
        none = strings()
        purpose = none if self.purpose is None else F.filter(
            strings(self.purpose), lambda v: v.isNotNull() & (v != ""))
        kinds = [purpose.alias("purpose")]
        for k in KINDS[1:]:
            parts = self.lists.get(k, [])
            kinds.append((F.concat(*parts) if parts else none).cast("array<string>").alias(k))
        return F.struct(*kinds)


def no_facts() -> Column:
    return Facts().column()
