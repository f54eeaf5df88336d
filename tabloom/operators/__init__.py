"""DataFrame operators."""

from .clean import (clean_headers, clean_names, drop_empty_columns, drop_empty_rows, drop_junk_rows, drop_missing,
                    fill_missing, filter_rows, merge_columns, rename_columns)
from .encode import encode_categorical, encode_frequency, encode_label, encode_onehot
from .correlation import correlations
from .found_dates import date_shapes, parse_dates_by_column
from .frequent import most_frequent
from .order_statistics import box_statistics, group_quantiles, quantiles
from .sparse import Sparse, sparse_onehot, sparse_tags
from .tables import (correlation_matrix, crosstab, crosstab_long, distributions, filter_in, group_summary, histogram,
                     key_metrics, ordinal_distribution, scatter_sample, share_by_group, time_trend, value_distribution)
from .tags import detect_tag_separator, explode_tags, tag_cooccurrence, tag_frequency, tag_vocabulary, tags_long
from .transforms import (bin_numeric, extract_date_features, infer_ordinal_order, make_ordinal, normalize, parse_dates,
                         parse_numeric_strings, to_boolean)

__all__ = [
    "Sparse", "correlations", "date_shapes", "parse_dates_by_column", "most_frequent", "sparse_onehot", "sparse_tags", "bin_numeric", "box_statistics", "clean_headers", "clean_names", "correlation_matrix", "crosstab", "crosstab_long",
    "detect_tag_separator", "distributions", "drop_empty_columns", "drop_empty_rows", "drop_junk_rows", "drop_missing",
    "encode_categorical", "encode_frequency", "encode_label", "encode_onehot", "explode_tags", "extract_date_features",
    "fill_missing", "filter_in", "filter_rows", "group_quantiles", "group_summary", "histogram", "infer_ordinal_order",
    "key_metrics", "make_ordinal", "merge_columns", "normalize", "ordinal_distribution", "parse_dates",
    "parse_numeric_strings", "quantiles", "rename_columns", "scatter_sample", "share_by_group", "tag_cooccurrence",
    "tag_frequency", "tag_vocabulary", "tags_long", "time_trend", "to_boolean", "value_distribution",
]
