"""A table together with its profile and column descriptions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..session import local_rows
from .incremental import ProfileState, Rescan, profile_state
from .statistics import merge_descriptions, profile_table
from .profiling import profile


@dataclass(frozen=True)
class Dataset:
    """Immutable: an update gives a new one."""

    df: DataFrame
    profile: DataFrame
    descriptions: Mapping[str, str] = field(default_factory=dict)
    view: str | None = None
    distinct: str = "exact"
    state: ProfileState | None = None

    @classmethod
    def of(cls, df: DataFrame, descriptions: Mapping[str, str] | None = None, view: str | None = None,
           distinct: str = "exact") -> Dataset:
        if not isinstance(df, DataFrame):
            raise TypeError("a Spark DataFrame is needed")
        if view:
            df.createOrReplaceTempView(view)
        known = dict(descriptions or {})
        return cls(df, profile(df, distinct), {c: known.get(c, "") for c in df.columns}, view, distinct)

    def update(self, new_df: DataFrame) -> Dataset:
        """Replace the table: profile it again, keep the descriptions of columns that survive, refresh the view."""
        return Dataset.of(new_df, self.descriptions, self.view, self.distinct)

    def append(self, rows: DataFrame) -> Dataset:
        """Add rows of the same columns: only they are profiled, and merged with what is known of the others.

        The first call measures the table once for that. Where the merged profile needs what was not kept of a part, the
        whole table is profiled.
        """
        state = (self.state or profile_state(self.df)).merge(profile_state(rows.select(*self.df.columns)))
        whole = self.df.unionByName(rows)
        if self.view:
            whole.createOrReplaceTempView(self.view)
        try:
            known = state.profile()
        except Rescan:
            known = profile(whole, self.distinct)
        return replace(self, df=whole, profile=known, state=state)

    def descriptions_table(self) -> DataFrame:
        return local_rows(self.df.sparkSession, list(self.descriptions.items()), "name string, description string")

    def table(self) -> DataFrame:
        """The profile table with descriptions."""
        return profile_table(self.profile, merge_descriptions(self.profile, self.descriptions_table()))
