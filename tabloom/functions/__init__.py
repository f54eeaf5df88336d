"""Column expressions: every function here takes and returns a ``Column`` and stays inside the JVM."""

from .bins import bin_index, equal_width_edges
from .booleans import boolean_from_text
from .cells import cell, free_name, name_key, present, unlike_names
from .dates import date_part, date_pattern_hint, parse_dates, parse_dates_as
from .numbers import numeric_from_text, text_prefix, text_suffix
from .ordinals import ordinal_rank
from .tags import part_count, split_tags, tag_suffix
from .text import normalise, strip

__all__ = [
    "bin_index", "boolean_from_text", "cell", "date_part", "date_pattern_hint", "equal_width_edges", "free_name",
    "name_key", "normalise", "numeric_from_text", "ordinal_rank", "parse_dates", "parse_dates_as", "part_count",
    "present", "split_tags", "strip", "tag_suffix", "text_prefix", "text_suffix", "unlike_names",
]
