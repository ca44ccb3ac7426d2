"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SLOTS = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame | None, max_rows: int,
                    max_chars: int) -> list[tuple[str, object]]:
    """Whole texts with their label: at most ``max_rows`` and ``max_chars`` for each label.

    ``docs`` has doc_id and text, ``labels`` doc_id and label, of which there are few; without
    ``labels`` the label is a column of ``docs``. Rows are taken in the order of a hash of their
    id, so the sample does not depend on how the tables are laid out. Only ids and lengths are
    looked at before the choice is made; the driver receives ``max_rows`` of those a label, then
    the chosen texts. A text longer than what is left of ``max_chars`` is passed over. Null texts,
    ids and labels are left out.
    """
    given = [] if labels is not None else ["label"]
    sized = docs.select("doc_id", F.length("text").alias("size"), *given).where(
        "doc_id IS NOT NULL AND size > 0")
    if labels is not None:
        sized = sized.join(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.max("label").alias("label")), "doc_id")
    sized = sized.where("label IS NOT NULL").withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(_SLOTS)))
    # Of a label with many rows only those in the first slots can be among the chosen; what is
    # sorted for a label is then about twice what is taken.
    last = F.lit(_SLOTS)
    for row in sized.groupBy("label").count().collect():
        slots = int(_SLOTS * (2 * max_rows + 100) / row["count"])
        last = F.when(F.col("label") == row["label"], min(slots, _SLOTS)).otherwise(last)
    ranked = (sized.where(F.col("slot") < last)
              .withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(
                  "slot", "doc_id", "size"))).where(F.col("k") <= max_rows))
    left: dict[object, int] = {}
    chosen = []
    for row in sorted(ranked.collect(), key=lambda r: (str(r["label"]), r["k"])):
        budget = left.setdefault(row["label"], max_chars)
        if row["size"] <= budget:
            left[row["label"]] = budget - row["size"]
            chosen.append((row["doc_id"], row["label"]))
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), ranked.select(
        "doc_id", "label").schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()
    return [(r["text"], r["label"]) for r in sorted(
        rows, key=lambda r: (r["doc_id"], r["text"] or "")) if r["text"]]
