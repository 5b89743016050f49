"""Reading, cleaning and writing."""

from tabulens.sources.cleaning import clean_table
from tabulens.sources.readers import read_csv, read_json, read_table
from tabulens.sources.sinks import report_document, write_report

__all__ = [
    "clean_table", "read_csv", "read_json", "read_table", "report_document", "write_report",
]
