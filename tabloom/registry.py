"""The registered queries: every operator over whole tables.

Each takes ``(spark, folder of Parquet tables)`` and returns a DataFrame. ``oracles.py`` holds the same in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, encode, found_dates, frequent, order_statistics, sparse, tables, tags, transforms
from .plans import statistics as d
from .plans import changes, guided, missing
from .plans.dataset import Dataset
from .plans.features import engineer
from .plans.incremental import profile_state
from .plans.profiling import profile, profile_values
from .plans.quality import quality_report
from .session import checkpoint_root, local_rows
from .sources import readers
from .sources.writers import save_one_file, save_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a careless export would give them: everything is text, in mixed spellings."""
    o = table(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("Order ID"),
        F.when(status == "F", "Sim").when(status == "O", " não").alias("Paid"),
        F.concat(F.lit("R$ "), F.col("o_totalprice").cast("decimal(15,2)").cast("string")).alias("Total Price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("orderDate"),
        F.concat(F.lower(F.substring_index(priority, "-", -1)), F.lit(", "),
                 F.when(status == "P", "plástico").otherwise("rede")).alias("tags"),
        F.when(priority == "1-URGENT", "High").when(priority == "2-HIGH", "high")
        .when(priority == "3-MEDIUM", "Medium").when(priority == "5-LOW", " low ").alias("level"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" was placed by customer "),
                 F.col("o_custkey").cast("string"), F.lit(" and is still to be shipped")).alias("note"),
        F.lit(None).cast("string").alias("_c7"),
    )


# ---- transforms ---------------------------------------------------------------------------------------------------

@query
def yes_no_share_by_group(spark, folder):
    items = transforms.to_boolean(table(spark, folder, "lineitem"), "l_returnflag", ["R"])
    return rounded(tables.share_by_group(items, "l_linestatus", "l_returnflag"), 9, "share")


@query
def to_boolean_given_words(spark, folder):
    o = transforms.to_boolean(table(spark, folder, "orders"), "o_orderstatus", ["f", "O"], "flag")
    return o.select("o_orderkey", "flag")


@query
def to_boolean_default_words(spark, folder):
    o = transforms.to_boolean(raw_orders(spark, folder), "Paid", output="paid_flag")
    return o.select(F.col("Order ID").alias("order_id"), "paid_flag")


@query
def to_boolean_numbers(spark, folder):
    lab = table(spark, folder, "labels")
    return transforms.to_boolean(transforms.to_boolean(lab, "quality"), "toxic")


@query
def parse_numeric_strings(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.concat(
        F.lit("R$ "), F.col("p_retailprice").cast("decimal(15,2)").cast("string"), F.lit(" %")).alias("price"))
    return transforms.parse_numeric_strings(p, "price")


@query
def parse_numeric_decimal_comma(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.translate(
        F.format_number("o_totalprice", 2), ",.", ".,").alias("price"))
    return transforms.parse_numeric_strings(o, "price", decimal=",")


@query
def parse_dates_mixed(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return transforms.parse_dates(o, "day")


@query
def parse_dates_day_first(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    return transforms.parse_dates(o, "day", day_first=True)


@query
def parse_dates_explicit(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("moment"))
    return transforms.parse_dates(e, "moment", "%d/%m/%Y %H:%M:%S")


def _days_in_unlisted_shapes(spark, folder):
    """Order days as eight digits, with the month's name, day first in some rows, and shipping days as day and month."""
    o = table(spark, folder, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    number = F.dayofmonth(day).cast("string")
    month = F.get(F.array(*[F.lit(m) for m in "jan fev mar abr mai jun jul ago set out nov dez".split()]), F.month(day) - 1)
    return o.select(
        "o_orderkey",
        F.when(k % 3 == 0, F.date_format(day, "yyyyMMdd"))
        .when(k % 3 == 1, F.concat(F.date_format(day, "EEE, "), number, F.lit(" de "), month, F.date_format(day, " yy 14'h'30")))
        .otherwise(F.date_format(day, "yyyy年M月d日")).alias("day"),
        F.when(k % 11 > 0, F.date_format(day, "d.M.yyyy h:mm a")).when(k % 2 == 0, "unknown").alias("shipped"))


@query
def parse_dates_by_column_unlisted(spark, folder):
    return found_dates.parse_dates_by_column(_days_in_unlisted_shapes(spark, folder), ["day", "shipped"])


@query
def parse_dates_by_column_order(spark, folder):
    """Days up to the twelfth could be read either way; the others of the column settle it."""
    e = table(spark, folder, "events").select("event_id", F.date_format("ts", "dd/MM/yy HH:mm:ss").alias("moment"))
    return found_dates.parse_dates_by_column(e, "moment")


@query
def date_shapes_orders(spark, folder):
    return found_dates.date_shapes(_days_in_unlisted_shapes(spark, folder))


@query
def extract_date_features(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts")
    return transforms.extract_date_features(e, "ts", "t").drop("ts")


@query
def extract_date_features_from_text(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return transforms.extract_date_features(o, "day")


@query
def bin_numeric_equal_width(spark, folder):
    p = transforms.bin_numeric(table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", 5, output="b")
    return p.select("p_partkey", "p_size", "b.bin", F.round("b.lo", 9).alias("lo"), F.round("b.hi", 9).alias("hi"))


@query
def bin_numeric_labelled_edges(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return transforms.bin_numeric(o, "o_totalprice", [1000, 50_000, 150_000, 400_000], ["low", "middle", "high"],
                                  "band")


@query
def normalize_minmax(spark, folder):
    c = transforms.normalize(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return rounded(c, 9, "c_acctbal_minmax")


@query
def normalize_zscore(spark, folder):
    c = transforms.normalize(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "zscore")
    return rounded(c, 8, "c_acctbal_zscore")


@query
def encode_onehot(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode_onehot(c, "c_mktsegment", "seg")


@query
def encode_label(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode_label(c, "c_mktsegment", "code")


@query
def encode_label_large_dictionary(spark, folder):
    """The path for dictionaries too large to broadcast."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_extendedprice")
    return encode.encode_label(li, "l_partkey", "code", broadcast_rows=100)


@query
def encode_label_with_nulls(spark, folder):
    o = raw_orders(spark, folder).select(F.col("Order ID").alias("order_id"), "level")
    return encode.encode_label(o, "level", "code")


@query
def encode_frequency(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(encode.encode_frequency(o, "o_orderpriority", "freq"), 9, "freq")


@query
def encode_frequency_large_dictionary(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return rounded(encode.encode_frequency(o, "o_custkey", "freq", broadcast_rows=100), 9, "freq")


@query
def make_ordinal_given_order(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return transforms.make_ordinal(o, "o_orderpriority", PRIORITIES)


@query
def make_ordinal_known_scale(spark, folder):
    o = raw_orders(spark, folder).select(F.col("Order ID").alias("order_id"), "level")
    return transforms.make_ordinal(o, "level")


# ---- tags ---------------------------------------------------------------------------------------------------------

@query
def explode_tags_part_names(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    return tags.explode_tags(p, "p_name", " ", "t")


@query
def explode_tags_found_separator(spark, folder):
    o = raw_orders(spark, folder).select(F.col("Order ID").alias("order_id"), "tags")
    return tags.explode_tags(o, "tags", prefix="t")


@query
def tags_long_part_names(spark, folder):
    return tags.tags_long(table(spark, folder, "part"), "p_name", " ", ["p_partkey"])


@query
def tag_vocabulary_documents(spark, folder):
    return tags.tag_vocabulary(table(spark, folder, "documents"), "text", ",")


@query
def tag_frequency_part_names(spark, folder):
    return tags.tag_frequency(table(spark, folder, "part"), "p_name", " ")


@query
def tag_frequency_documents(spark, folder):
    return tags.tag_frequency(table(spark, folder, "documents"), "text", ",")


@query
def tag_cooccurrence_part_names(spark, folder):
    return tags.tag_cooccurrence(table(spark, folder, "part"), "p_name", " ")


@query
def tag_cooccurrence_orders(spark, folder):
    return tags.tag_cooccurrence(raw_orders(spark, folder), "tags", ",")


@query
def tag_separators(spark, folder):
    """The separator found in each text column of several tables."""
    rows = []
    for name, column in (("documents", "text"), ("part", "p_name"), ("events", "props"), ("conversations", "text"),
                         ("pages", "url")):
        rows.append((name, column, tags.detect_tag_separator(table(spark, folder, name), column)))
    return local_rows(spark, rows, "source string, column string, separator string")


# ---- tables behind charts -----------------------------------------------------------------------------------------

@query
def key_metrics(spark, folder):
    m = tables.key_metrics(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(m, 4, *[f"{c}_{s}" for c in ("l_quantity", "l_extendedprice", "l_discount")
                           for s in ("sum", "mean", "min", "max")])


@query
def group_summary(spark, folder):
    m = tables.group_summary(table(spark, folder, "events"), ["event_type"], ["value"])
    return rounded(m, 6, "value_mean", "value_std")


@query
def value_distribution_status(spark, folder):
    return rounded(tables.value_distribution(table(spark, folder, "orders"), "o_orderstatus"), 9, "share")


@query
def value_distribution_with_nulls(spark, folder):
    return rounded(tables.value_distribution(raw_orders(spark, folder), "level", dropna=False), 9, "share")


@query
def distributions(spark, folder):
    li = table(spark, folder, "lineitem")
    return rounded(tables.distributions(li, ["l_returnflag", "l_linestatus", "l_linenumber"]), 9, "share")


@query
def crosstab(spark, folder):
    return tables.crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")


@query
def crosstab_long(spark, folder):
    return tables.crosstab_long(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query
def histogram(spark, folder):
    return rounded(tables.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 12), 6, "lo", "hi")


@query
def histogram_given_edges(spark, folder):
    return tables.histogram(table(spark, folder, "lineitem"), "l_quantity", [0, 10, 20, 30, 40, 50, 60, 70])


@query
def box_statistics(spark, folder):
    b = order_statistics.box_statistics(table(spark, folder, "orders"), "o_totalprice")
    return rounded(b, 6, "q1", "median", "q3")


@query
def box_statistics_by_group(spark, folder):
    b = order_statistics.box_statistics(table(spark, folder, "events"), "value", "event_type")
    return rounded(b, 6, "q1", "median", "q3")


@query
def quantiles_of_many_groups(spark, folder):
    q = order_statistics.group_quantiles(table(spark, folder, "orders"), (0.1, 0.5, 0.9), "o_custkey", "o_totalprice")
    return rounded(rounded(q, 8, "mean", "q0", "q1", "q2"), 6, "std")


@query
def scatter_sample(spark, folder):
    return tables.scatter_sample(table(spark, folder, "orders"), "o_custkey", "o_totalprice", 500, ["o_orderkey"])


@query
def correlation_matrix(spark, folder):
    c = tables.correlation_matrix(table(spark, folder, "lineitem"),
                                  ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(c, 8, "r")


@query
def time_trend_monthly(spark, folder):
    return rounded(tables.time_trend(table(spark, folder, "orders"), "o_orderdate", "month", "o_totalprice"), 4,
                   "total", "mean")


@query
def time_trend_hourly_filled(spark, folder):
    errors = tables.filter_in(table(spark, folder, "events"), {"event_type": ["error"]})
    return rounded(tables.time_trend(errors, "ts", "hour", "value", fill=True), 6, "total", "mean")


@query
def ordinal_distribution(spark, folder):
    return rounded(tables.ordinal_distribution(table(spark, folder, "orders"), "o_orderpriority", PRIORITIES), 9,
                   "share")


@query
def ordinal_distribution_known_scale(spark, folder):
    return rounded(tables.ordinal_distribution(raw_orders(spark, folder), "level"), 9, "share")


@query
def filtered_distribution(spark, folder):
    li = tables.filter_in(table(spark, folder, "lineitem"), {"l_returnflag": ["A", "N"], "l_linestatus": ["O"]})
    return rounded(tables.value_distribution(li, "l_linenumber"), 9, "share")


# ---- cleaning -----------------------------------------------------------------------------------------------------

@query
def clean_headers(spark, folder):
    return clean.clean_headers(raw_orders(spark, folder))


@query
def drop_junk_rows(spark, folder):
    """Pending orders become divider rows, open ones repeated headers."""
    o = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    text = {c: F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderpriority")}
    raw = o.select(
        F.when(status == "O", " O_ORDERKEY ").otherwise(text["o_orderkey"]).alias("o_orderkey"),
        F.when(status == "O", "o_custkey").when(status == "F", text["o_custkey"]).alias("o_custkey"),
        F.when(status == "O", "O_orderpriority").when(status == "F", text["o_orderpriority"]).otherwise(" ")
        .alias("o_orderpriority"))
    return clean.drop_junk_rows(raw)


@query
def drop_empty(spark, folder):
    raw = raw_orders(spark, folder).select("Paid", "level", "_c7")
    return clean.drop_empty_rows(clean.drop_empty_columns(raw))


@query
def merge_rename_filter(spark, folder):
    o = clean.filter_rows(raw_orders(spark, folder), "level is not null or Paid is not null")
    merged = clean.merge_columns(o, ["Paid", "level"], "state", "/")
    return clean.rename_columns(merged, {"Order ID": "order_id"}).select("order_id", "state")


@query
def missing_values(spark, folder):
    o = raw_orders(spark, folder).select(F.col("Order ID").alias("order_id"), "Paid", "level")
    return clean.fill_missing(clean.drop_missing(o, ["level"]), {"Paid": "?"}).withColumnRenamed("Paid", "paid")


@query
def fill_missing_mean(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return rounded(clean.fill_missing(o, method="mean", columns=["price"]), 4, "price")


# ---- profile ------------------------------------------------------------------------------------------------------

def flat_profile(p: DataFrame) -> DataFrame:
    """A profile without arrays and maps."""
    words = F.map_keys(F.map_filter("boolean_map", lambda _, v: v))
    others = F.map_keys(F.map_filter("boolean_map", lambda _, v: ~v))
    return p.select(
        "name", "semantic_type", "nullable", "n_unique", "n_total", "n_null", "tag_separator", "n_tags",
        F.array_join("tag_vocabulary", "|").alias("vocabulary"), F.array_join(F.array_sort(words), "|").alias("yes"),
        F.array_join(F.array_sort(others), "|").alias("no"), F.array_join("ordinal_order", "|").alias("scale"),
        "numeric_prefix", "numeric_suffix", F.array_join("categories", "|").alias("categories"), "date_format_hint",
        F.round("avg_length", 6).alias("avg_length"))


PROFILED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
            "benchmark", "labels", "conversations"]

for _name in PROFILED:
    QUERIES[f"profile_{_name}"] = lambda spark, folder, name=_name: flat_profile(profile(table(spark, folder, name)))


@query
def profile_raw_orders(spark, folder):
    return flat_profile(profile(raw_orders(spark, folder)))


def merged_profile(df: DataFrame, key: str) -> DataFrame:
    """The profile of a table from the states of its halves."""
    even = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    return profile_state(df.where(even)).merge(profile_state(df.where(~even))).profile()


@query
def profile_merged_orders(spark, folder):
    return flat_profile(merged_profile(table(spark, folder, "orders"), "o_orderkey"))


@query
def profile_merged_documents(spark, folder):
    return flat_profile(merged_profile(table(spark, folder, "documents"), "doc_id"))


@query
def profile_merged_raw_orders(spark, folder):
    return flat_profile(merged_profile(raw_orders(spark, folder), "Order ID"))


@query
def profile_with_approximate_counts(spark, folder):
    """Types only: the counts themselves are estimates."""
    return profile(table(spark, folder, "lineitem"), distinct="approx").select("name", "semantic_type")


@query
def profile_with_prose_guard(spark, folder):
    return profile(table(spark, folder, "documents"), prose_guard=True).select("name", "semantic_type", "n_unique")


@query
def summary_lines(spark, folder):
    return d.summary_lines(profile(raw_orders(spark, folder)))


@query
def column_overview(spark, folder):
    return d.column_overview(table(spark, folder, "orders")).drop("dtype")


@query
def dataset_metrics(spark, folder):
    return d.dataset_metrics(table(spark, folder, "lineitem"))


@query
def type_distribution(spark, folder):
    return d.type_distribution(profile(raw_orders(spark, folder)))


@query
def dominant_type(spark, folder):
    return d.dominant_type(profile(table(spark, folder, "lineitem")))


@query
def profile_table(spark, folder):
    notes = {"Paid": "whether the order was paid", "level": "urgency"}
    return Dataset.of(raw_orders(spark, folder), notes).table().drop("dtype")


@query
def suggested_analyses(spark, folder):
    return d.suggest(profile(raw_orders(spark, folder)))


@query
def updated_view(spark, folder):
    """The view of a dataset after an update that drops one column and adds another, with the kept descriptions."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = Dataset.of(o, {"o_orderkey": "key", "o_orderstatus": "state"}, view="updated_orders", distinct="approx")
    new = old.update(transforms.to_boolean(o, "o_orderstatus", ["F"], "done").drop("o_orderstatus"))
    notes = new.descriptions_table().where("description <> ''").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "description"))), ";")).scalar()
    return spark.table("updated_orders").withColumn("notes", notes)


@query
def detected_changes(spark, folder):
    old = table(spark, folder, "orders")
    new = (clean.drop_missing(raw_orders(spark, folder), ["level"]).select(F.col("Order ID").alias("o_orderkey"))
           .withColumn("o_custkey", F.lit(1).cast("long")).withColumn("note", F.lit("x")))
    return d.detect_changes(old, new)


def _describe(df: DataFrame) -> DataFrame:
    return rounded(d.describe(df), 4, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_orders(spark, folder):
    return _describe(table(spark, folder, "orders"))


@query
def describe_lineitem(spark, folder):
    return _describe(table(spark, folder, "lineitem"))


@query
def describe_documents(spark, folder):
    return _describe(table(spark, folder, "documents"))


@query
def quality_report_raw_orders(spark, folder):
    return rounded(quality_report(raw_orders(spark, folder)), 9, "ratio")


@query
def profile_values_raw_orders(spark, folder):
    raw = raw_orders(spark, folder)
    return profile_values(raw, profile(raw))


@query
def profile_values_documents(spark, folder):
    """All tags of the texts too, far more than a profile lists."""
    docs = table(spark, folder, "documents")
    return profile_values(docs, profile(docs, distinct="approx"))


@query
def profile_embeddings(spark, folder):
    return flat_profile(profile(table(spark, folder, "embeddings")))


@query
def dataset_summary_lines(spark, folder):
    """The summary's lines up to the first rows, which any rows may be."""
    o = table(spark, folder, "orders")
    text = d.dataset_summary(o, profile(o), max_rows=0)
    lines = text.split("\n\nFirst")[0].split("\n")
    return local_rows(spark, list(enumerate(lines)), "place int, line string")


# ---- missing numbers -----------------------------------------------------------------------------------------------

def with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose price class is NaN where the order is pending."""
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(
        F.floor(F.col("o_totalprice") / 100_000) % 3).cast("double")
    flag = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise((F.col("o_orderstatus") == "F").cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", price.alias("price"), flag.alias("flag"))


@query
def encode_label_with_nan(spark, folder):
    return encode.encode_label(with_nan(spark, folder), "price", "code").select("o_orderkey", "code")


@query
def encode_frequency_with_nan(spark, folder):
    found = encode.encode_frequency(with_nan(spark, folder), "price", "share").select("o_orderkey", "share")
    return rounded(found, 9, "share")


@query
def encode_onehot_with_nan(spark, folder):
    found = encode.encode_onehot(with_nan(spark, folder), "price", "p")
    return found.select("o_orderkey", *[F.col(f"`p_{v}.0`").alias(f"p{v}") for v in range(3)])


@query
def distribution_with_nan(spark, folder):
    return rounded(tables.value_distribution(with_nan(spark, folder), "price"), 9, "share")


@query
def crosstab_with_nan(spark, folder):
    return tables.crosstab_long(with_nan(spark, folder), "o_orderpriority", "price")


@query
def share_with_nan(spark, folder):
    return rounded(tables.share_by_group(with_nan(spark, folder), "o_orderpriority", "price"), 9, "share")


@query
def fill_mean_with_nan(spark, folder):
    filled = clean.fill_missing(with_nan(spark, folder), method="mean", columns=["price"])
    return rounded(filled.select("o_orderkey", "price"), 6, "price")


@query
def engineer_with_nan(spark, folder):
    o = with_nan(spark, folder).select("o_orderkey", "flag")
    return engineer(o, profile(o, distinct="approx"))


@query
def encode_onehot_case(spark, folder):
    """Values that differ in case only keep columns that can be written and read again."""
    raw = raw_orders(spark, folder).select(F.col("Order ID").alias("order_id"), "level")
    path = f"{checkpoint_root(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    encode.encode_onehot(raw, "level", "is").drop("level").write.parquet(path)
    return spark.read.parquet(path).withColumnRenamed("is_ low ", "is_low")


# ---- engineering --------------------------------------------------------------------------------------------------

@query
def engineer_raw_orders(spark, folder):
    raw = clean.clean_headers(raw_orders(spark, folder))
    return engineer(raw, profile(raw))


@query
def guided_distributions(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return rounded(run.tables["distributions"](), 9, "share")


@query
def guided_trend(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return run.tables["trend:order_date"]()


@query
def guided_tag_pairs(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return run.tables["tag_pairs:tags"]()


@query
def guided_report(spark, folder):
    return rounded(guided.guided_run(raw_orders(spark, folder)).report, 9, "ratio")


@query
def guided_features(spark, folder):
    return guided.guided_run(raw_orders(spark, folder)).features


@query
def guided_key_metrics(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return rounded(run.tables["key_metrics"](), 4, *[f"total_price_{s}" for s in ("sum", "mean", "min", "max")])


@query
def guided_summary(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return rounded(run.tables["summary:paid"](), 6, "total_price_mean", "total_price_std")


@query
def guided_box(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return rounded(run.tables["box:total_price"](), 6, "q1", "median", "q3")


@query
def guided_ordinal(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return rounded(run.tables["ordinal:level"](), 9, "share")


@query
def guided_tags(spark, folder):
    run = guided.guided_run(raw_orders(spark, folder))
    return run.tables["tags:tags"]()


# ---- sources ------------------------------------------------------------------------------------------------------

def _copy(spark: SparkSession, df: DataFrame, fmt: str) -> str:
    """Write the table into the shared checkpoint folder, under a name of its own."""
    path = f"{checkpoint_root(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    save_table(df, path, fmt)
    return path


@query
def csv_round_trip(spark, folder):
    return readers.load_table(spark, _copy(spark, table(spark, folder, "orders"), "csv"), "csv")


@query
def tsv_round_trip(spark, folder):
    return readers.load_table(spark, _copy(spark, table(spark, folder, "customer"), "tsv"), "tsv")


@query
def csv_header_over_two_rows(spark, folder):
    """Section titles and names as the first two lines, found and dropped by content."""
    c = table(spark, folder, "customer").select(*[F.col(x).cast("string").alias(x) for x in (
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment")])
    rows = c.select(F.concat_ws(",", *c.columns).alias("value"))
    titles = local_rows(spark, [("Customer,,Account,",), ("Key,Name,Balance,Segment",)], "value string").coalesce(1)
    path = f"{checkpoint_root(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    titles.unionAll(rows).write.text(path)
    return readers.read_csv_under_header(spark, path, 2)


@query
def json_round_trip(spark, folder):
    events = table(spark, folder, "events")
    millis = F.floor(d.epoch_seconds(events, "ts")) * 1_000
    e = events.select("event_id", millis.alias("created_at"), "event_type", "value")
    return readers.load_table(spark, _copy(spark, e, "json"), "json")


@query
def xml_round_trip(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return readers.load_table(spark, _copy(spark, p, "xml"), "xml", row_tag="row")


@query
def csv_round_trip_documents(spark, folder):
    """Texts with line breaks, quotes and separators."""
    return readers.load_table(spark, _copy(spark, table(spark, folder, "documents"), "csv"), "csv")


@query
def tsv_round_trip_documents(spark, folder):
    return readers.load_table(spark, _copy(spark, table(spark, folder, "documents"), "tsv"), "tsv")


@query
def xml_row_element_found(spark, folder):
    """The row element is found by the reader."""
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return readers.load_table(spark, _copy(spark, c, "xml"), "xml")


@query
def json_array(spark, folder):
    """One array of records over several lines."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    text = F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), ",\n"), F.lit("\n]"))
    path = f"{checkpoint_root(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    n.agg(text.alias("value")).write.text(path)
    return readers.load_table(spark, path, "json")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tabloom-{uuid.uuid4().hex}"


@query
def csv_one_file_documents(spark, folder):
    """All documents in one file whose cells hold line breaks; its splits are tasks of their own, as its parts were."""
    path = _folder(spark)
    save_one_file(table(spark, folder, "documents"), path, "csv")
    return readers.load_table(spark, path, "csv")


@query
def csv_other_column_orders(spark, folder):
    """A folder of files that name their columns in another order; one of them lacks a column."""
    o, path = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), _folder(spark)
    first, second, third = (o.filter(F.pmod("o_orderkey", F.lit(3)) == k) for k in range(3))
    save_table(first, path, "csv")
    save_table(second.select("o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey"), path, "csv", "append")
    save_table(third.select("o_custkey", "o_orderkey", "o_totalprice"), path, "csv", "append")
    return readers.load_table(spark, path, "csv")


@query
def csv_header_over_two_rows_documents(spark, folder):
    """Titles in two rows above texts with line breaks, quotes and separators."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, folder, "documents").select(
        F.concat_ws(",", F.col("doc_id").cast("string"), quoted, "lang", "source", F.col("n_chars").cast("string")).alias("value"))
    titles = local_rows(spark, [('Document,,"Where\nfrom",,Size',), ("Key,Text,Language,Source,Characters",)],
                        "value string").coalesce(1)
    path = _folder(spark)
    titles.unionAll(rows).write.text(path)
    return readers.read_csv_under_header(spark, path, 2)


@query
def json_mixed_layouts(spark, folder):
    """One folder of records per line, arrays over lines, arrays of one line, and records laid out over lines."""
    docs, path = table(spark, folder, "documents"), _folder(spark)
    parts = [docs.filter(F.pmod("doc_id", F.lit(4)) == k) for k in range(4)]
    save_table(parts[0], path, "json")
    compact = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    pretty = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("value")))), lambda r: r["value"])
    for part, text, glue, ends in ((parts[1], compact, ",\n", ("[\n", "\n]")), (parts[2], compact, ", ", ("[", "]")),
                                   (parts[3], pretty, "\n", ("", ""))):
        # Some files of each layout, each of them a value of one row.
        rows = part.select("doc_id", text.alias("value")).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("file"))
        whole = rows.agg(F.concat(F.lit(ends[0]), F.array_join(in_order, glue), F.lit(ends[1])).alias("value"))
        whole.repartition(64, "file").select("value").write.mode("append").text(path)
    return readers.load_table(spark, path, "json")


# ---- frequent values, sparse indicators, patterns and changes -----------------------------------------------------

@query
def most_frequent_values(spark, folder):
    """The five most frequent customers, days and totals of the orders."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("customer"), F.date_format(
        "o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("total"))
    return frequent.most_frequent(o.unpivot([], ["customer", "day", "total"], "name", "value"), 5)


@query
def profile_most_frequent_documents(spark, folder):
    """Tags of a vocabulary that is too long for the profile."""
    p = profile(table(spark, folder, "documents")).where("most_frequent is not null")
    return p.select("name", "n_tags", F.posexplode("most_frequent").alias("place", "value"))


@query
def engineer_documents(spark, folder):
    """Thousands of tags as one sparse column."""
    docs = table(spark, folder, "documents")
    e = engineer(docs, profile(docs))
    return e.select("doc_id", "lang", "source", "n_chars", F.array_join(F.col("text_tags").cast("array<string>"), ",").alias("text_tags"))


@query
def sparse_tag_sums_documents(spark, folder):
    """Rows per tag, summed over the sparse column."""
    return sparse.sparse_tags(table(spark, folder, "documents"), "text", ",").sums()


@query
def sparse_onehot_customers(spark, folder):
    """Some customers of the orders as columns on request."""
    o = sparse.sparse_onehot(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return o.with_indicators({"is_1": "1", "is_4": "4", "is_none": "none"}).drop("o_custkey_value")


def _wide_items(spark, folder):
    """Twenty columns of numbers, some of them missing in places, some far from zero."""
    i = table(spark, folder, "lineitem")
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    base = [q, p, d, t, q * d, p * t + q, q * q, p / q]
    columns = [c.alias(f"a{k}") for k, c in enumerate(base)]
    columns += [F.when(F.col("l_orderkey") % (k + 2) != 0, c + F.lit(1e6)).alias(f"b{k}") for k, c in enumerate(base)]
    return i.select(*columns)


@query
def correlation_matrix_wide(spark, folder):
    items = _wide_items(spark, folder)
    return rounded(tables.correlation_matrix(items, items.columns), 6, "r")


@query
def tag_cooccurrence_frequent_documents(spark, folder):
    """Pairs that at least twenty documents hold, of millions of pairs."""
    return tags.tag_cooccurrence(table(spark, folder, "documents"), "text", ",", min_rows=20)


def _planted_gaps(spark, folder):
    """Orders whose customer and price are missing together, with the day beside them in a part of these rows."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.when(k % 7 > 0, F.col("o_custkey")).alias("customer"),
                    F.when(k % 7 > 0, F.col("o_totalprice")).otherwise(float("nan")).alias("price"),
                    F.when(k % 14 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("  ").alias("day"),
                    F.when((k % 14 > 0) & (k % 5 > 0), F.col("o_orderpriority")).alias("priority"))


@query
def missing_patterns(spark, folder):
    found = missing.missing_patterns(raw_orders(spark, folder))
    return rounded(found.withColumn("columns", F.array_join("columns", "+")), 9, "ratio")


@query
def missing_together_planted(spark, folder):
    found = missing.missing_together(_planted_gaps(spark, folder))
    return rounded(found.withColumn("columns", F.array_join("columns", "+")), 9, "ratio")


@query
def cell_changes_orders(spark, folder):
    """Changed, cleared, lost and new rows of the orders, and a column of another type."""
    old = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = old.where(k % 89 > 0).withColumns({
        "o_custkey": F.when(k % 97 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string"),
        "o_orderstatus": F.when(k % 101 > 0, F.col("o_orderstatus"))})
    more = old.where(k % 83 == 0).withColumns({"o_orderkey": k + 100_000_000, "o_custkey": F.col("o_custkey").cast("string")})
    return changes.cell_changes(old, new.unionByName(more).repartition(5), "o_orderkey")
