"""tierline: inspection intelligence as Spark DataFrame operators.

Sub-packages
------------
functions   Column expressions (grades, names, notices, dates, bands ...)
sources     readers and sinks (register CSV, feeds, pages, phrase files)
operators   DataFrame -> DataFrame building blocks (upsert, match, score ...)
plans       report and serving queries composed from the operators
streaming   the incremental news merge
"""
