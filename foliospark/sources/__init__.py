"""Where documents come from and results go: tables, files, vectors."""

from .registry import DatasetRegistry
from .sinks import write_sheets, write_table
from .tabular import read_csv, read_excel, read_table, sample, sheet_names
from .vector_files import attach_by_id, attach_by_order, read_vectors

__all__ = ["DatasetRegistry", "attach_by_id", "attach_by_order", "read_csv", "read_excel", "read_table", "read_vectors", "sample", "sheet_names", "write_sheets", "write_table"]
