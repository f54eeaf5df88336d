"""Data-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean_names, filled_cells, header_echo, is_unnamed
from ..session import local_rows
from .profiling import profile as make_profile

_SCHEMA = "column string, issue string, n long, ratio double"


def quality_report(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``column, issue, n, ratio``: what a cleaning step should look at.

    Per column, from the profile: ``unnamed_header``, ``messy_header``, ``empty_column``, ``missing_values``,
    ``untyped_boolean``, ``untyped_date``, ``untyped_number``, ``tags_in_cell``, ``unordered_scale``, ``mixed_types``
    and ``high_cardinality``; ``n`` counts the rows concerned. For the table (``column`` is ``*``), from one scan:
    ``empty_row``, ``divider_row`` and ``repeated_header``.
    """
    p = make_profile(df) if profile is None else profile
    n_total, filled = F.col("n_total"), F.col("n_total") - F.col("n_null")
    kind = F.col("semantic_type")
    is_text = F.col("dtype") == "string"
    numbers = F.round(F.coalesce("numeric_share", F.lit(0.0)) * filled).cast("long")
    dates = F.round(F.coalesce("date_share", F.lit(0.0)) * filled).cast("long")
    odd = F.least(numbers, filled - numbers)
    headers = local_rows(df.sparkSession, [(c, is_unnamed(c), clean != c and not is_unnamed(c))
                                           for c, clean in zip(df.columns, clean_names(df.columns))],
                         "header string, unnamed boolean, messy boolean")
    checks = {
        "unnamed_header": (F.col("unnamed"), n_total),
        "messy_header": (F.col("messy"), n_total),
        "empty_column": (filled == 0, n_total),
        "missing_values": ((F.col("n_null") > 0) & (filled > 0), F.col("n_null")),
        "untyped_boolean": (is_text & (kind == "boolean"), filled),
        "untyped_date": (kind == "date_string", dates),
        "untyped_number": (kind == "numeric_string", numbers),
        "tags_in_cell": (kind == "multi_value_tags", filled),
        "unordered_scale": (kind == "ordinal", filled),
        "mixed_types": (is_text & (odd > 0) & ~kind.isin("date_string", "boolean"), odd),
        "high_cardinality": (kind.isin("identifier", "free_text"), F.col("n_unique")),
    }
    found = F.array(*[F.when(holds, F.struct(F.lit(name).alias("issue"), n.cast("long").alias("n")))
                      for name, (holds, n) in checks.items()])
    per_column = (p.join(headers, F.col("name") == F.col("header"))
                  .select(F.col("name").alias("column"), "n_total",
                          F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i"))
                  .select("column", "i.issue", "i.n", F.try_divide(F.col("i.n"), F.col("n_total")).alias("ratio")))

    cells = filled_cells(df)
    wide = len(df.columns) > 2
    table = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(cells == 0).alias("empty_row"),
                   (F.count_if(cells == 1) if wide else F.lit(0).cast("long")).alias("divider_row"),
                   F.count_if(header_echo(df)).alias("repeated_header"))
    per_table = (table.unpivot("rows", ["empty_row", "divider_row", "repeated_header"], "issue", "n").where("n > 0")
                 .select(F.lit("*").alias("column"), "issue", "n", F.try_divide(F.col("n"), F.col("rows")).alias("ratio")))
    return per_column.unionByName(per_table)
