"""Reading tables: CSV, TSV, JSON, XML and workbooks, from a file, a folder or a glob."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import WHITESPACE
from ..functions import name_key, parse_dates, strip, unlike_names
from ..operators.clean import clean_names, merged_header
from ..session import local_rows
from . import splits
from .workbook import read_workbooks

# ---- fixed values: texts that stand for a missing cell, besides the empty one -----------------------------------------
MISSING_TEXTS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
# ---- end of fixed values ----------------------------------------------------------------------------------------------

_INTEGER = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def blank_missing(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing cell to null."""
    missing = ["", *MISSING_TEXTS]
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        columns.append((F.when(~c.isin(*missing), c) if isinstance(f.dataType, T.StringType) else c).alias(f.name))
    return df.select(*columns)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns that hold only whole numbers, numbers or true/false become bigint, double or boolean.

    One scan judges all columns. Dates stay text: telling them apart is the profile's work. A column without any value
    becomes double.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    tests = []
    for i, name in enumerate(texts):
        c = F.col(f"`{name}`")
        whole = c.rlike(_INTEGER)
        tests += [F.count(c).alias(f"n{i}"), F.count_if(whole & strip(c).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                  F.count_if(whole).alias(f"w{i}"), F.count_if(c.rlike(_FLOAT)).alias(f"f{i}"),
                  F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}")]
    seen = df.agg(*tests).first()
    casts = {}
    for i, name in enumerate(texts):
        n, c = seen[f"n{i}"], F.col(f"`{name}`")
        if n == 0:
            casts[name] = c.try_cast("double")
        elif seen[f"i{i}"] == n:
            casts[name] = strip(c).try_cast("bigint")
        elif seen[f"f{i}"] == n and seen[f"w{i}"] < n:
            casts[name] = strip(c).try_cast("double")
        elif seen[f"b{i}"] == n:
            casts[name] = F.lower(c) == "true"
    return df.select(*[casts.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


#: Characters of a line that are looked at to find the row element of XML.
LINE_LENGTH = 100_000
_BLANK = "\ufeff \t\r\n"
#: A string of JSON, with the colon after it if it is a name. Strings are taken whole, so that each character is read once.
_JSON_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"(?:\s*:)?|\\?\z)'


def _first_rows(spark: SparkSession, path: str, n: int, *facts: Column) -> list[Row]:
    """``facts`` of the first lines (``value``) of the first file by name that is not empty, by the task that reads them.
    Spark itself would start with the largest file; sizes are asked of the file system, without a job."""
    for file in sorted(spark.read.text(path).inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(unquote(file))
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen():
            return spark.read.text(unquote(file)).select(*facts).limit(n).collect()
    return []


def _first_lines(spark: SparkSession, path: str, n: int, length: int | None = None) -> list[str]:
    """First lines of the first file by name that is not empty, cut to ``length`` characters if given."""
    value = F.col("value") if length is None else F.left("value", F.lit(length))
    return [r[0].removeprefix("\ufeff") for r in _first_rows(spark, path, n, value)]


def _csv_files(spark: SparkSession, path: str, look: bool) -> list[tuple[str, bool, str]]:
    """Each file of ``path`` that is not blank: ``file, broken, first line``. ``look`` for lines that leave a quote open:
    a cell of the file holds a line break, or a stray quote.

    One count per file over all lines; with more than one file another scan for their first lines. What reaches the driver
    is one row per file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place"),
        (F.col("_metadata.file_block_start") == 0).alias("top"))
    some = F.length(F.trim("value")) > 0
    if not look and len(lines.inputFiles()) == 1:
        return [(lines.inputFiles()[0], False, line) for line in _first_lines(spark, path, 1)]
    seen = lines.filter(some).groupBy("file").agg(
        F.max((quotes % 2 if look else F.lit(0)) == 1).alias("odd"), F.min(F.when(F.col("top"), F.col("place"))).alias("place"))
    found = [r for r in seen.collect() if r["place"] is not None]
    if len(found) == 1 and len(lines.inputFiles()) == 1:
        return [(found[0]["file"], found[0]["odd"], line) for line in _first_lines(spark, path, 1)]
    places = local_rows(spark, [(r["file"], r["place"], r["odd"]) for r in found], "file string, place long, odd boolean")
    firsts = lines.join(F.broadcast(places), ["file", "place"]).select("file", "odd", F.ltrim("value", F.lit("\ufeff")))
    return sorted(tuple(r) for r in firsts.collect())


def _plain_path(uri: str) -> str:
    return re.sub("^file:/+", "/", unquote(uri))


def _header_names(line: str, sep: str, key: Callable[[str], str] = str.lower) -> list[str]:
    """Names of a header line; missing ones become ``_c{i}``, those that look the same to the session get ``_2``, ``_3``."""
    cells = next(csv.reader(io.StringIO(line, newline=""), delimiter=sep), [])
    names = [name or f"_c{i}" for i, name in enumerate(cells)]
    return unlike_names(names, key)


def sniff_separator(line: str) -> str:
    """Tab if the line holds one, else semicolon, else comma."""
    return next((s for s in ("\t", ";") if s in line), ",")


def _csv_cells(spark: SparkSession, files: list[str], broken: list[str], sep: str, width: int, header: bool) -> DataFrame:
    """Cells ``c0, c1, …`` of CSV files without their header line; those of ``broken`` files may hold line breaks."""
    # As many columns as the header has, whatever the rows below it hold.
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    options = dict(sep=sep, quote='"', escape='"', encoding="UTF-8")
    parts = []
    if files:
        parts.append(spark.read.csv(files, header=header, schema=schema, enforceSchema=True, **options))
    if broken:
        own = splits.records(spark, broken, splits.CsvScanner(sep))
        own = own.filter(~F.col("first")) if header else own
        parsed = F.from_csv("record", schema.toDDL(), {**options, "multiLine": "true"}).alias("r")
        parts.append(own.select(parsed).select("r.*"))
    return reduce(DataFrame.unionAll, parts)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, infer: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """CSV with a header line in each file; the separator is judged from the first one.

    Files may name their columns in another order or have others: cells go by name, columns a file lacks are null. Cells
    may hold line breaks inside quotes. Files that have such cells are found by counting the quotes of their lines, and
    their records are put together over line ends and splits (``splits``); all others are parsed line by line.
    ``multi_line`` says for all files instead whether cells may hold line breaks.
    """
    files = _csv_files(spark, path, multi_line is None)
    key = name_key(spark)
    if not files:
        return spark.createDataFrame([], T.StructType([]))
    sep = sep or sniff_separator(files[0][2])
    groups: dict[tuple[str, ...], tuple[list[str], list[str]]] = {}
    for file, odd, line in files:
        broken = odd or bool(multi_line)
        if broken and line.count('"') % 2:  # the header itself holds a line break
            line = splits.records(spark, [_plain_path(file)], splits.CsvScanner(sep)).filter("first").first()["record"]
        names = tuple(_header_names(line, sep, key))
        groups.setdefault(names, ([], []))[int(broken)].append(_plain_path(file))
    parts = [_csv_cells(spark, plain, broken, sep, len(names), True).toDF(*names)
             for names, (plain, broken) in groups.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return infer_types(blank_missing(df)) if infer else df


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_csv_under_header(spark: SparkSession, path: str, header_rows: int = 1, sep: str | None = None,
                          infer: bool = True) -> DataFrame:
    """CSV whose names are spread over the first rows, such as merged section titles above the real header.

    Only those rows reach the driver, which builds the names. The rows are then read without a header, and rows equal
    to one of the header rows are filtered out, in every file. Cells, titles too, may hold line breaks.
    """
    files = _csv_files(spark, path, True)
    if not files:
        raise ValueError(f"{path} is empty")
    sep = sep or sniff_separator(files[0][2])
    plain, broken = ([_plain_path(f) for f, odd, _ in files if odd is kind] for kind in (False, True))
    first = _plain_path(files[0][0])
    if files[0][1]:
        top = splits.records(spark, [first], splits.CsvScanner(sep)).select("record")
    else:
        top = spark.read.text(first).filter(F.length(F.trim("value")) > 0)
    lines = [r[0].removeprefix("\ufeff") for r in top.limit(header_rows).collect()]
    titles = [next(csv.reader(io.StringIO(line, newline=""), delimiter=sep), []) for line in lines]
    names = clean_names(merged_header(titles))
    body = _csv_cells(spark, plain, broken, sep, len(names), False)
    for title in titles:
        same = F.lit(True)
        for i in range(len(names)):
            cell = (title[i] if i < len(title) else "").strip(WHITESPACE)
            same = same & (F.coalesce(strip(F.col(f"c{i}")), F.lit("")) == cell)
        body = body.where(~same)
    named = body.toDF(*names)
    return infer_types(blank_missing(named)) if infer else named


def _is_date_name(name: str) -> bool:
    low = name.lower()
    return low.endswith(("_at", "_time")) or low.startswith("timestamp") or low in ("modified", "date")


# Largest value that reads as a date before 2262 in seconds, milliseconds and microseconds.
_LAST_SECOND = 9_223_372_036
_FIRST_EPOCH = 31_536_000


def dates_by_name(df: DataFrame) -> DataFrame:
    """Columns named like dates (``date``, ``*_at``, ``*_time``, ``timestamp*``, ``modified``) to timestamps.

    Whole numbers are epoch seconds, milliseconds, microseconds or nanoseconds, judged by the largest of them; text is
    converted when every value reads as a date. Everything else stays. One scan of these columns.
    """
    named = [f for f in df.schema if _is_date_name(f.name) and isinstance(f.dataType, (T.LongType, T.StringType))]
    if not named:
        return df
    tests = []
    for i, f in enumerate(named):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.LongType):
            tests += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        else:
            tests += [F.count(c).alias(f"lo{i}"), F.count(parse_dates(c)).alias(f"hi{i}")]
    seen = df.agg(*tests).first()
    casts = {}
    for i, f in enumerate(named):
        c, lo, hi = F.col(f"`{f.name}`"), seen[f"lo{i}"], seen[f"hi{i}"]
        if isinstance(f.dataType, T.StringType):
            if lo and lo == hi:
                casts[f.name] = parse_dates(c)
        elif lo is not None and lo > _FIRST_EPOCH:
            scale = next((s for s in (1, 1_000, 1_000_000) if hi <= _LAST_SECOND * s), 1_000_000_000)
            micros = c * F.lit(1_000_000 // scale) if scale <= 1_000_000 else F.floor(c / F.lit(1_000))
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            casts[f.name] = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                       (micros / F.lit(1_000_000)).cast("decimal(18,6)"))
    return df.select(*[casts.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of ``path`` that hold one object per line, and all others; blank ones are neither. One count per file."""
    line = F.trim("value", F.lit(_BLANK))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
    # Two objects of one line have no comma between them; inside of a value there always is one.
    whole = F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}")) & ~F.regexp_like("line", F.lit(r"\}\s*\{"))
    seen = lines.filter("line <> ''").groupBy("file").agg(F.count_if(~whole).alias("others")).collect()
    return tuple(sorted(_plain_path(r["file"]) for r in seen if (r["others"] > 0) is other) for other in (False, True))


def _named_order(records: DataFrame, columns: list[str]) -> list[str]:
    """``columns`` in the order in which the first records name them."""
    names = F.filter(F.regexp_extract_all("record", F.lit(_JSON_STRING), F.lit(0)), lambda s: F.endswith(s, F.lit(":")))
    keys = F.array_intersect(F.transform(names, lambda s: F.regexp_replace(s, r'^"|"\s*:$', "")), F.lit(columns))
    order = dict.fromkeys(key for r in records.select(keys).limit(200).collect() for key in r[0])
    return [*order, *[c for c in columns if c not in order]]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON records in any layout, file by file: one per line, an array, or objects laid out over lines; epoch numbers in
    columns named like dates become timestamps.

    Files of one record per line go to Spark's own reader. The records of all others are put together over line ends and
    splits (``splits``), an array of one line too. What is no record, a file that ends inside one and column-oriented JSON
    are errors.
    """
    lines, others = _json_files(spark, path)
    if not lines and not others:
        raise ValueError(f"{path} is empty")
    text = spark.read.text(lines).select(F.trim("value", F.lit(_BLANK)).alias("record")).filter("record <> ''") if lines else None
    if others:
        records = splits.records(spark, others, splits.JsonScanner()).select("record")
        records = records if text is None else text.unionAll(records)
        schema = spark.read.json(records.rdd.map(lambda r: r[0])).schema
        parsed = F.from_json("record", schema, {"mode": "PERMISSIVE"}).alias("r")
        df = records.select(parsed).select("r.*")
    else:
        records, df = text, spark.read.json(lines)
    nested = [f for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    lone = df.columns and len(nested) == len(df.columns) and len(records.limit(2).collect()) == 1
    if "_corrupt_record" in df.columns or lone:
        raise ValueError(f"{path}: only JSON records can be read; column-oriented JSON is one value that cannot be split "
                         "into rows")
    return dates_by_name(df.select(*[F.col(f"`{c}`") for c in _named_order(records, df.columns)]))


def find_row_tag(lines: list[str]) -> str | None:
    """Name of the first element inside the root element."""
    text = re.sub(r"<!--.*?-->|<\?.*?\?>|<!\w[^>]*>", "", "\n".join(lines), flags=re.DOTALL)
    tags = re.findall(r"<([A-Za-z_][\w.\-:]*)", text)
    return tags[1] if len(tags) > 1 else None


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """XML with one element per row; the row element is the first one below the root unless named."""
    tag = row_tag or find_row_tag(_first_lines(spark, path, 50, LINE_LENGTH))
    if tag is None:
        raise ValueError(f"{path}: no row element found; pass row_tag")
    df = spark.read.format("xml").options(rowTag=tag, inferSchema=False, attributePrefix="").load(path)
    return infer_types(blank_missing(df))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook; all workbooks of a folder must share their header."""
    return infer_types(blank_missing(read_workbooks(spark, path)))


LOADERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".xml": read_xml, ".xlsx": read_xlsx,
}


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by the lower-cased file extension, or by ``fmt`` for folders. Parquet and ORC are read as they are."""
    ext = f".{fmt.lower().lstrip('.')}" if fmt else PurePosixPath(path.lower().rstrip("/")).suffix
    if ext in (".parquet", ".orc"):
        return spark.read.format(ext[1:]).load(path)
    if ext not in LOADERS:
        raise ValueError(f"unsupported file format '{ext}'; supported: {', '.join(sorted([*LOADERS, '.parquet', '.orc']))}")
    return LOADERS[ext](spark, path, **options)
