"""Dataset statistics and the small tables made from a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SEMANTIC_TYPES
from ..operators.frequent import counts_by_digest, top_of_counts
from ..operators.order_statistics import group_quantiles
from ..session import freeze, local_rows
from .profiling import as_text, column_kind, long_form, present


def describe(df: DataFrame) -> DataFrame:
    """One row per column: ``count``, and by kind

    - text and boolean: ``unique``, ``top`` and ``freq``, the most frequent value (the smallest of equals);
    - numbers: ``mean``, ``std`` (sample), ``min``, ``p25``, ``p50``, ``p75``, ``max``, quartiles exact;
    - dates and timestamps: the same as epoch seconds in the number columns, without ``std``.
    """
    fields = [(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    names = {
        "number": [n for _, n, t in fields if isinstance(t, T.NumericType)],
        "datetime": [n for _, n, t in fields if column_kind(t) == "datetime"],
        "text": [n for _, n, t in fields if isinstance(t, (T.BooleanType, T.StringType, T.CharType, T.VarcharType))],
    }
    parts = []
    measured = names["number"] + names["datetime"]
    if measured:
        values = df.select(*[(present(df, n).cast("double") if n in names["number"] else epoch_seconds(df, n))
                             .alias(str(i)) for i, n in enumerate(measured)])
        cells = values.unpivot([], [str(i) for i in range(len(measured))], "g", "x").where("x is not null")
        figures = group_quantiles(cells, (0.25, 0.5, 0.75), groups=len(measured)).toDF(
            "g", "count", "mean", "std", "min", "max", "p25", "p50", "p75")
        is_date = F.col("g").cast("int") >= len(names["number"])
        parts.append(figures.select(
            F.get(F.array(*[F.lit(n) for n in measured]), F.col("g").cast("int")).alias("name"), "count",
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), "mean", F.when(~is_date, F.col("std")).alias("std"),
            "min", "p25", "p50", "p75", "max"))
    if names["text"]:
        none = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
        cells = long_form(df, names["text"])
        counts = freeze(counts_by_digest(cells))
        sizes = counts.groupBy("name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
        best = top_of_counts(cells, counts, 1).select("name", F.col("value").alias("top"), F.col("n").alias("freq"))
        parts.append(sizes.join(F.broadcast(best), "name").select(  # a row per column
            F.get(F.array(*[F.lit(n) for n in names["text"]]), F.col("name").cast("int")).alias("name"),
            "count", "unique", "top", "freq", *none))
    if not parts:
        raise ValueError("no column can be described")
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 as double, exact to the microsecond for current dates; local times count as UTC."""
    moment = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(moment).cast("double") / 1e6
    local = moment.cast("timestamp_ntz")
    whole = F.unix_date(local.cast("date")).cast("long") * 86_400 + F.hour(local) * 3_600 + F.minute(local) * 60
    return whole.cast("double") + F.extract(F.lit("SECOND"), local).cast("double")


def dataset_metrics(df: DataFrame) -> DataFrame:
    """``n_rows, n_columns``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_overview(df: DataFrame) -> DataFrame:
    """``name, dtype, n_filled, n_unique`` per column: the head of a dataset summary."""
    from .profiling import profile

    return profile(df).select("name", "dtype", (F.col("n_total") - F.col("n_null")).alias("n_filled"), "n_unique")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows as text, for display."""
    return df.limit(n).select(*[as_text(df, c).alias(c) for c in df.columns])


def _quoted(c, limit: int):
    shown = F.transform(F.slice(c, 1, limit), lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.concat_ws(", ", shown), F.lit("]"), F.when(F.size(c) > limit, "…").otherwise(""))


def _keys(flag: bool):
    words = F.map_keys(F.map_filter("boolean_map", lambda _, v: v == F.lit(flag)))
    return _quoted(F.array_sort(words), 100)


def _listed(column: str, limit: int):
    """The first entries of a list, or the most frequent ones where it is too long for the profile."""
    often = F.slice("most_frequent", 1, limit)
    return (F.when(F.col(column).isNotNull(), F.concat(F.lit(": "), _quoted(F.col(column), limit)))
            .when(often.isNotNull(), F.concat(F.lit(", most frequent: "), _quoted(often, limit), F.lit("…")))
            .otherwise(""))


def detail(profile: DataFrame, tags: int = 12, values: int = 10):
    """What matters for the column's type, as one text."""
    kind = F.col("semantic_type")
    return (F.when(kind == "boolean", F.concat(F.lit("true="), _keys(True), F.lit(", false="), _keys(False)))
            .when(kind == "multi_value_tags", F.concat(
                F.lit("sep='"), F.col("tag_separator"), F.lit("', "), F.col("n_tags").cast("string"), F.lit(" tags"),
                _listed("tag_vocabulary", tags)))
            .when(kind == "categorical", F.concat(
                F.col("n_unique").cast("string"), F.lit(" categories"), _listed("categories", values)))
            .when(kind == "ordinal", F.array_join("ordinal_order", " → "))
            .when(kind == "numeric_string", F.concat(F.lit("prefix='"), F.col("numeric_prefix"), F.lit("' suffix='"),
                                                     F.col("numeric_suffix"), F.lit("'")))
            .when(kind == "date_string", F.concat(F.lit("pattern: "), F.col("date_format_hint")))
            .when(kind == "free_text", F.concat(F.lit("average length "), F.format_number("avg_length", 0)))
            .otherwise(""))


def profile_table(profile: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """``name, dtype, semantic_type, n_unique, nullable, detail, description`` in column order."""
    table = profile.withColumn("detail", detail(profile))
    if descriptions is not None:
        table = table.join(descriptions.select("name", "description"), "name", "left")
    else:
        table = table.withColumn("description", F.lit(""))
    return table.orderBy("position").select("name", "dtype", "semantic_type", "n_unique", "nullable", "detail",
                                            F.coalesce("description", F.lit("")).alias("description"))


def summary_lines(profile: DataFrame) -> DataFrame:
    """One line of text per column, in column order."""
    d = detail(profile)
    return (profile.withColumn("detail", d).orderBy("position")
            .select("name", F.concat(F.col("name"), F.lit(" — "), F.col("semantic_type"),
                                     F.when(F.col("detail") != "", F.concat(F.lit(": "), F.col("detail")))
                                     .otherwise("")).alias("line")))


def dataset_summary(df: DataFrame, profile: DataFrame, max_rows: int = 5) -> str:
    """Readable text: shape, columns, semantic types, first rows and statistics. Only these few rows are collected."""
    rows = profile.orderBy("position").collect()
    n_rows = rows[0]["n_total"] if rows else df.count()
    lines = [f"{n_rows} rows x {len(df.columns)} columns", "", "Columns:"]
    lines += [f"  {r['name']} ({r['dtype']}): {r['n_total'] - r['n_null']} filled, {r['n_unique']} distinct" for r in rows]
    lines += ["", "Meaning:"] + [f"  {r['line']}" for r in summary_lines(profile).collect()]
    lines += ["", f"First {max_rows} rows:"] + ["  " + " | ".join("" if v is None else v for v in r)
                                               for r in head(df, max_rows).collect()]
    lines += ["", "Statistics:"]
    for r in describe(df).collect():
        lines.append("  " + ", ".join(f"{key}={value}" for key, value in r.asDict().items() if value is not None))
    return "\n".join(lines)


def type_distribution(profile: DataFrame) -> DataFrame:
    """``semantic_type, n``: columns per type."""
    return profile.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n"))


def dominant_type(profile: DataFrame) -> DataFrame:
    """The type of most columns; of equals, the one that occurs first."""
    counts = profile.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("semantic_type", "n")


# (rank, analysis, types it is for); an empty list always applies.
_ANALYSES = [
    (1, "summary of the dataset and its column types", []),
    (2, "proportions of boolean and categorical columns", ["boolean", "categorical"]),
    (3, "frequency of each tag", ["multi_value_tags"]),
    (4, "distribution of ordinal columns in order", ["ordinal"]),
    (5, "distributions and correlations of numeric columns", ["numeric", "numeric_string"]),
]
_MORE = "further analyses of interest"


def suggest(profile: DataFrame, limit: int = 4) -> DataFrame:
    """``rank, analysis, columns``: up to four analyses that fit the column types, and the columns they use."""
    every = [(rank, analysis, kind) for rank, analysis, kinds in _ANALYSES for kind in kinds or SEMANTIC_TYPES]
    rules = local_rows(profile.sparkSession, every, "rank int, analysis string, semantic_type string")
    chosen = (rules.join(profile.select("position", "name", "semantic_type"), "semantic_type")
              .groupBy("rank", "analysis")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))),
                                            lambda s: s["name"]), ", ").alias("columns")))
    few = chosen.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select(
        F.lit(99).alias("rank"), F.lit(_MORE).alias("analysis"), F.lit("").alias("columns"))
    return chosen.unionByName(few).orderBy("rank").limit(limit)


def merge_descriptions(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``name, description`` for the new columns: kept where the name survives, blank where it is new."""
    return (columns.select("name").join(descriptions.select("name", "description"), "name", "left")
            .select("name", F.coalesce("description", F.lit("")).alias("description")))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, item, detail``: columns added, removed or of another type, a new column order, and the row difference."""
    before = {f.name: f.dataType.simpleString() for f in old.schema}
    after = {f.name: f.dataType.simpleString() for f in new.schema}
    rows = [("column_removed", c, t) for c, t in before.items() if c not in after]
    rows += [("column_added", c, t) for c, t in after.items() if c not in before]
    rows += [("type_changed", c, f"{before[c]} -> {t}") for c, t in after.items() if before.get(c, t) != t]
    if sorted(before) == sorted(after) and list(before) != list(after):
        rows.append(("columns_reordered", "", ", ".join(after)))
    schema = "change string, item string, detail string"
    found = local_rows(old.sparkSession, rows, schema)
    n_old = old.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = (new.agg(F.count(F.lit(1)).alias("n")).withColumn("delta", F.col("n") - n_old).where("delta <> 0")
              .select(F.lit("row_count").alias("change"), F.lit("").alias("item"),
                      F.col("delta").cast("string").alias("detail")))
    return found.unionByName(counts)
