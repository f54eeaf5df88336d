"""Feature engineering by profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fx
from ..functions.dates import DATE_PARTS
from ..operators.encode import add_columns
from ..operators.found_dates import parse_dates_by_column
from ..operators.sparse import sparse_tags
from ..operators.tags import explode_tags


def engineer(df: DataFrame, profile: DataFrame, date_parts: bool = True, decimal: str = ".",
             day_first: bool | None = False, skip: Sequence[str] = ()) -> DataFrame:
    """Give every column the type its profile says.

    Boolean words become booleans, number-like text doubles and date text timestamps, in place; scales are normalised
    and get a ``_rank``; tag columns get an indicator per tag; dates get their
    parts. Everything but the tag indicators is one projection, and the profile holds the
    orders and short vocabularies. Tags whose vocabulary is too long for it become one sparse column ``{name}_tags``, an array
    of the sorted numbers of the tags, in their order; ``sparse_tags`` gives their dictionary. With ``day_first=None`` date
    text is read by the shapes and the order of day and month that a scan of these columns finds.
    """
    rows = [r for r in profile.orderBy("position").collect() if r["name"] in df.columns and r["name"] not in skip]
    if day_first is None:
        df = parse_dates_by_column(df, [r["name"] for r in rows if r["semantic_type"] == "date_string"])
    replaced, added, tagged = {}, {}, []
    for r in rows:
        name, kind = r["name"], r["semantic_type"]
        c = fx.cell(name)
        if kind == "boolean" and r["dtype"] != "boolean":
            yes = [word for word, value in (r["boolean_map"] or {}).items() if value]
            replaced[name] = (fx.present(df, name) == 1) if r["dtype"] != "string" else fx.boolean_from_text(c, yes)
        elif kind == "numeric_string":
            replaced[name] = fx.numeric_from_text(c, decimal)
        elif kind == "date_string" and day_first is not None:
            replaced[name] = fx.parse_dates(c, day_first)
        elif kind == "ordinal":
            rank = fx.ordinal_rank(c, r["ordinal_order"])
            replaced[name] = F.when(rank.isNotNull(), fx.normalise(c))
            added[f"{name}_rank"] = rank
        elif kind == "multi_value_tags":
            tagged.append(r)
    ranks = add_columns(df, added) if added else df
    result = ranks.withColumns(replaced) if replaced else ranks
    for r in rows:
        if r["semantic_type"] == "ordinal":
            result = result.withMetadata(r["name"], {"ordinal_order": list(r["ordinal_order"])})
    if date_parts:
        # Midnight dates have no hour worth a column, but which they are is only known by reading them.
        parts = {f"{r['name']}_{part}": fx.date_part(fx.cell(r["name"]), part)
                 for r in rows if r["semantic_type"] in ("date_string", "datetime") for part in DATE_PARTS}
        result = add_columns(result, parts) if parts else result
    for r in tagged:
        # The profile lists the word nan like any other; as a tag it means missing.
        if r["tag_vocabulary"] is None:
            result = sparse_tags(result, r["name"], r["tag_separator"]).data
            continue
        words = [t for t in r["tag_vocabulary"] if t.lower() != "nan"]
        result = explode_tags(result, r["name"], r["tag_separator"], vocabulary=words)
    return result
