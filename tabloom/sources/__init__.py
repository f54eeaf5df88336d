"""Reading and writing tables."""

from .readers import (dates_by_name, infer_types, load_table, read_csv, read_csv_under_header, read_json, read_tsv,
                      read_xlsx, read_xml)
from .writers import save_one_file, save_table

__all__ = ["dates_by_name", "infer_types", "load_table", "read_csv", "read_csv_under_header", "read_json", "read_tsv",
           "read_xlsx", "read_xml", "save_one_file",
           "save_table"]
