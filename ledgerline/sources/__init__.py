"""Reading extracts and references, writing dated reports, bulk workbook ingest."""

from ledgerline.sources.reports import read_report, report_label, write_report, write_reports
from ledgerline.sources.tables import read_checked, read_table, required_values
from ledgerline.sources.workbook import ingest_checked, ingest_workbooks, write_workbooks

__all__ = [
    "ingest_checked",
    "ingest_workbooks",
    "read_checked",
    "read_report",
    "read_table",
    "report_label",
    "required_values",
    "write_report",
    "write_reports",
    "write_workbooks",
]
