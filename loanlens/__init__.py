"""loanlens — loan-portfolio analytics on Spark DataFrames.

Layout:
  sources/    loan table: derived view over the driver tables, explicit schema,
              CSV / Parquet readers and writers
  functions/  canonical numeric forms (averages, percentages, rounding) and the
              bucket ladders
  operators/  reusable DataFrame -> DataFrame operators (segment profiles,
              shares, entity roll-ups, ranks, scenarios, additive scores ...)
  plans/      the 38 analyses plus generic instances on native tables, each
              with an equivalent DuckDB SQL oracle
  streaming/  the same analyses over a file stream of loan records
"""

from loanlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
