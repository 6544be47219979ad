from stockflow.sources.adapters import RawTables, raw_tables  # noqa: F401
from stockflow.sources.tables import read_table  # noqa: F401
