from stockflow.plans.catalog import QUERIES, Workspace  # noqa: F401
from stockflow.plans.oracle import ORACLE_SQL  # noqa: F401
