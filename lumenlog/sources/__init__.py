"""Readers and writers."""

from lumenlog.sources.readers import (
    chunk_lines,
    list_datasets,
    read_delimited_logs,
    read_headerless,
    read_logs,
    read_structured,
    read_templates,
    stream_lines,
    validate_dataset,
)
from lumenlog.sources.sinks import append_logs, create_logs_table, write_csv, write_json, write_report, write_template_files

__all__ = [
    "append_logs", "chunk_lines", "create_logs_table", "list_datasets", "read_delimited_logs", "read_headerless", "read_logs", "read_structured",
    "read_templates", "stream_lines", "validate_dataset", "write_csv", "write_json", "write_report", "write_template_files",
]
