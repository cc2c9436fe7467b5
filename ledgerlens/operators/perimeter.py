"""Perimeter: valid codes, projection, first-wins dedup (AGG-9, AGG-10, MAP-11).

Row order decides the winner, so every input carries an order column
(``ord``: source file, row position).  Dedup is a grouped ``min_by`` over the
order: Spark plans it as a partial + final aggregate, so a key that holds a
third of the rows is reduced inside each map task before the shuffle; no row
set of one key is ever sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code_text, strip_ws, valid_code

# Identifier columns used for dedup, in priority order.
ID_COLUMNS = ("#Ticket", "Trade ID", "External Id")


def dedup_first(df: DataFrame, keys: list[str], order_col: str = "ord") -> DataFrame:
    """AGG-9: first row (lowest ``order_col``) per key; null keys are equal."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(packed, F.col(order_col)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])
    )


def build_perimeter(
    raw: DataFrame,
    code_col: str,
    class_col: str,
    id_cols: list[str],
    meta_cols: list[str] = (),
    order_col: str = "ord",
    dedup: bool = True,
) -> DataFrame:
    """MAP-11 + FLT-1 + AGG-9: in-scope rows projected to the perimeter layout.

    ``Code DI`` is the stripped code text; ``Classif DI`` and ``Class`` both
    come from the class column; id and meta columns are kept when present.
    """
    cols: list[Column] = [
        code_text(code_col).alias("code_di"),
        F.col(class_col).alias("classif_di"),
        F.col(class_col).alias("class"),
    ]
    cols += [F.col(c) for c in list(id_cols) + list(meta_cols) if c in raw.columns]
    peri = raw.where(valid_code(code_col)).select(*cols, F.col(order_col))
    present_ids = [c for c in id_cols if c in raw.columns]
    if dedup and present_ids:
        peri = dedup_first(peri, present_ids, order_col)
    return peri


def dedup_stats(peri_before: DataFrame, id_cols: list[str]) -> DataFrame:
    """AGG-10: rows before / after dedup and the keys used, in one aggregate."""
    keys_text = ", ".join(id_cols)
    per_key = peri_before.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.lit(keys_text).alias("dedup_keys"),
        F.sum("_n").cast("long").alias("dedup_before"),
        F.count(F.lit(1)).alias("dedup_after"),
    )
