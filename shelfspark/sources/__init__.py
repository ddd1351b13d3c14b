"""Sources: the driver's parquet tables, the catalog adapter, CSV and JSON readers."""

from shelfspark.sources.tables import TABLES, read_table
from shelfspark.sources.catalog import (
    alias_columns,
    catalog_view,
    normalize_names,
    raw_catalog,
    read_catalog_csv,
    write_catalog_csv,
)

__all__ = [
    "TABLES", "read_table", "alias_columns", "catalog_view", "normalize_names",
    "raw_catalog", "read_catalog_csv", "write_catalog_csv",
]
