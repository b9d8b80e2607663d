"""Sources and sinks: file-backed marketplace tables and the TPC-H-shaped test data."""

from souk.sources.tables import Tables, load_tables, write_results
from souk.sources.export_csv import load_export_csv
from souk.sources.tpch import from_tpch

__all__ = ["Tables", "load_tables", "load_export_csv", "write_results", "from_tpch"]
