"""stockflow — retail demand & inventory analytics as Spark DataFrame jobs.

Layers:
  sources/    driver-table adapters, CSV / JSON / Parquet I/O and contracts
  functions/  reusable column expressions (title case, clip, currency, week end)
  operators/  DataFrame-in / DataFrame-out jobs (cleaning, features, weekly
              roll-up, metrics, risk, marts, profiling, forecasting)
  plans/      the registered queries and their DuckDB oracle SQL
  streaming/  (nothing: every input of the domain is a finished batch table)
"""

__version__ = "0.1.0"
