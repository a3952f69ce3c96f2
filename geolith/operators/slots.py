"""A mention's slots as one array: what packing, softmax and padding amount to, without a row per slot.

A mention has `slots` slots: its candidates in order, the one for no entry, padding, and a last one
that stands for none of them, whose features are fixed. All but the candidates are constants, so the
softmax over all slots needs the candidates' logits and the number of padding slots alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.operators.features import FEATURES, PADDING


def logit(weights: tuple[float, ...]) -> Column:
    """The weighted features of a candidate."""
    out = F.lit(0.0)
    for w, c in zip(weights, FEATURES):
        out = out + F.col(c).cast("double") * F.lit(float(w))
    return out


def constants(weights: tuple[float, ...], strict: bool = False) -> tuple[float, float, float]:
    """The logits of the slot for no entry, of padding and of the last slot."""
    total = lambda value: sum(w * value(c) for w, c in zip(weights, FEATURES))
    null = total(lambda c: PADDING if c.endswith("_dist") else -1.0 if c.endswith("_match") else float(strict) if c.endswith("_count") else 0.0)
    return null, total(lambda c: 0.0 if c.endswith(("_count", "_match")) else PADDING), -float(sum(weights))


def _no_entry(column: str, kind: str) -> object:
    """What the slot for no entry has in a column."""
    if column.endswith("_dist"):
        return PADDING
    if column.endswith("_match"):
        return -1
    return "NULL" if kind == "string" else 0.0 if kind == "double" else None


def scored(rows: DataFrame, slots: int, weights: tuple[float, ...], keep: tuple[str, ...], places: int | None = None, strict: bool = False) -> DataFrame:
    """doc_id, mention_id, real (array of score, slot, place of the candidates and the one for no entry, best first), last and best (scores of the last slot and of any).

    rows: candidates with FEATURES and slot (null for a mention without any), dealt by document or mention. Of
    equal scores the earlier slot is first. A candidate in the last slot has that slot's score. Scores are rounded to `places`.
    """
    null, pad, last = constants(weights, strict)
    kinds = dict(rows.dtypes)
    place = F.struct(F.lit(True).alias("real"), *keep)
    kind = f"struct<real: boolean, {', '.join(f'{c}: {kinds[c]}' for c in keep)}>"
    no_entry = F.struct(F.lit(True).alias("real"), *(F.lit(_no_entry(c, kinds[c])).cast(kinds[c]).alias(c) for c in keep))
    entry = lambda x, s, p: F.struct(x.cast("double").alias("logit"), s.cast("int").alias("slot"), p.cast(kind).alias("place"))
    end = F.lit(slots - 1)
    own = F.when(F.col("slot") < slots, entry(F.when(F.col("slot") == end, F.lit(last)).otherwise(logit(weights)), F.col("slot"), place))
    by = rows.groupBy("doc_id", "mention_id").agg(F.collect_list(own).alias("own"))
    n = F.size("own")
    none = F.array(entry(F.when(n == end, F.lit(last)).otherwise(F.lit(null)), n, no_entry))
    by = by.withColumn("own", F.when(n < slots, F.concat("own", none)).otherwise(F.col("own")))
    by = by.withColumns({"pads": F.greatest(F.lit(0), end - F.size("own")), "ended": F.exists("own", lambda x: x.slot == end)})
    high = F.greatest(F.array_max(F.transform("own", lambda x: x.logit)), F.lit(last), F.when(F.col("pads") > 0, F.lit(pad)))
    by = by.withColumn("high", high)
    e = lambda x: F.exp(x - F.col("high"))
    total = F.aggregate("own", F.lit(0.0), lambda acc, x: acc + e(x.logit)) + F.col("pads") * e(F.lit(pad)) + F.when(F.col("ended"), 0.0).otherwise(e(F.lit(last)))
    by = by.withColumn("total", total)
    share = lambda x: F.round(e(x) / F.col("total"), places) if places is not None else e(x) / F.col("total")
    real = F.array_sort(F.transform("own", lambda x: F.struct((-share(x.logit)).alias("less"), x.slot.alias("slot"), x.place.alias("place"))))
    return by.select("doc_id", "mention_id", F.transform(real, lambda x: F.struct((-x.less).alias("score"), x.slot.alias("slot"), x.place.alias("place"))).alias("real"), share(F.lit(last)).alias("last"), share(F.col("high")).alias("best"))
