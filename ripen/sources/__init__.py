from .tables import read_table, rename_columns, require_columns, write_days, write_table
from .events import read_events, raw_impressions

__all__ = [
    "read_table", "rename_columns", "require_columns", "write_days", "write_table",
    "read_events", "raw_impressions",
]
