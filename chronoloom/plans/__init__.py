"""The analytical jobs. Each takes and returns DataFrames and runs nothing by itself, but for the
count of rows per entity that ``Timeline.measured`` makes.

Thresholds and column names are keyword arguments. Results come unordered, since a global sort
costs one more shuffle; ``ordered=True`` sorts them as a report.
"""
