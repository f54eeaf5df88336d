"""From a raw table to dashboard tables: audit, clean, engineer, tabulate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import combinations

from pyspark.sql import DataFrame

from ..operators import clean, order_statistics, tables, tags
from ..session import local_rows, stored
from .features import engineer
from .profiling import profile
from .quality import quality_report


@dataclass(frozen=True)
class GuidedResult:
    report: DataFrame
    cleaned: DataFrame
    features: DataFrame
    profile: DataFrame
    tables: dict[str, Callable[[], DataFrame]]
    problems: tuple[str, ...] = ()


def clean_table(df: DataFrame) -> DataFrame:
    """Clean headers, drop junk rows, empty rows and empty columns."""
    labels = list(df.columns)
    named = clean.clean_headers(df)
    return clean.drop_empty_columns(clean.drop_empty_rows(clean.drop_junk_rows(named, names=labels)))


def profile_of_cleaned(df: DataFrame, raw_profile: DataFrame, cleaned: DataFrame, distinct: str = "exact") -> DataFrame:
    """The profile of ``cleaned``, which ``clean_table`` made of ``df``: that of ``df`` under the new names where no row was
    dropped, as cleaning changes no cell; measured anew otherwise."""
    rows = raw_profile.orderBy("position").collect()
    if not rows or cleaned.count() != rows[0]["n_total"]:
        return profile(cleaned, distinct)
    names = df.columns if cleaned.columns == df.columns else clean.clean_names(df.columns)
    place = {name: i for i, name in enumerate(cleaned.columns)}
    kept = [r.asDict() | {"name": name, "position": place[name]} for r, name in zip(rows, names, strict=True) if name in place]
    return local_rows(df.sparkSession, [tuple(r[f] for f in raw_profile.columns) for r in kept], raw_profile.schema)


def dashboard_tables(features: DataFrame, source: DataFrame, prof: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The tables that suit the column types, each as a function that makes it: nothing runs for tables not asked for.

    ``source`` is the table before tags were spread over columns, ``prof`` its profile.
    """
    rows = prof.orderBy("position").collect()
    of = {kind: [r["name"] for r in rows if r["semantic_type"] == kind] for kind in {r["semantic_type"] for r in rows}}
    groups = [r["name"] for r in rows if r["semantic_type"] in ("boolean", "categorical") and r["n_unique"]]
    numeric = of.get("numeric", []) + of.get("numeric_string", [])
    found: dict[str, Callable[[], DataFrame]] = {}
    if numeric:
        found["key_metrics"] = partial(tables.key_metrics, features, numeric)
    if groups:
        found["distributions"] = partial(tables.distributions, features, groups)
    for a, b in combinations(groups, 2):
        found[f"crosstab:{a}:{b}"] = partial(tables.crosstab_long, features, a, b)
        found[f"shares:{a}:{b}"] = partial(tables.share_by_group, features, a, b)
    for by in groups if numeric else ():
        found[f"summary:{by}"] = partial(tables.group_summary, features, [by], numeric)
    for c in numeric:
        found[f"histogram:{c}"] = partial(tables.histogram, features, c)
        found[f"box:{c}"] = partial(order_statistics.box_statistics, features, c)
        for by in groups:
            found[f"box:{c}:{by}"] = partial(order_statistics.box_statistics, features, c, by)
    if len(numeric) >= 2:
        found["correlation"] = partial(tables.correlation_matrix, features, numeric)
    for x, y in combinations(numeric, 2):
        found[f"scatter:{x}:{y}"] = partial(tables.scatter_sample, features, x, y)
    for c in of.get("datetime", []) + of.get("date_string", []):
        found[f"trend:{c}"] = partial(tables.time_trend, features, c, "month")
    for r in rows:
        if r["semantic_type"] == "multi_value_tags":
            found[f"tags:{r['name']}"] = partial(tags.tag_frequency, source, r["name"], r["tag_separator"])
            found[f"tag_pairs:{r['name']}"] = partial(tags.tag_cooccurrence, source, r["name"], r["tag_separator"])
        if r["semantic_type"] == "ordinal":
            found[f"ordinal:{r['name']}"] = partial(tables.ordinal_distribution, features, r["name"],
                                                    r["ordinal_order"])
    return found


def guided_run(df: DataFrame, distinct: str = "exact") -> GuidedResult:
    """Audit, clean, engineer and tabulate. A step that fails leaves the table as it was and is noted.

    The cleaned and the engineered table are computed once and stored in the checkpoint folder; so a step that fails on a
    row is noticed at its end, and the tables of the dashboard read what they need from there.
    """
    problems: list[str] = []

    def attempt(step: str, run: Callable[[], DataFrame], fallback: DataFrame) -> DataFrame:
        try:
            return run()
        except Exception as error:  # noqa: BLE001 - whatever fails, the run goes on with the unchanged table
            problems.append(f"{step}: {error}")
            return fallback

    raw_profile = profile(df, distinct)
    report = quality_report(df, raw_profile)
    cleaned = attempt("clean", lambda: stored(clean_table(df)), df)
    prof = profile_of_cleaned(df, raw_profile, cleaned, distinct)
    features = attempt("engineer", lambda: stored(engineer(cleaned, prof)), cleaned)
    return GuidedResult(report, cleaned, features, prof, dashboard_tables(features, cleaned, prof), tuple(problems))
