"""ledgerlens: valuation-control jobs for OTC-derivative reports on Spark.

Subpackages
-----------
functions  scalar rules as Column expressions (numbers, dates, labels)
sources    readers: driver tables, file listings, archives, feeds, cells
operators  DataFrame -> DataFrame steps (grid, mapping, perimeter, enrich,
           forwards, reconcile, period, placement)
plans      the registered queries and their SQL oracles
streaming  file-stream wrapper around the batch steps
"""

__version__ = "0.1.0"
