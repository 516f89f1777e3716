"""namewright: entity resolution and scan scoring on PySpark.

Subpackages: ``functions`` (column expressions and numeric kernels), ``operators``
(DataFrame to DataFrame), ``sources`` (readers and writers), ``plans`` (end-to-end
pipelines and the query catalogue) and ``streaming`` (the same operators on streams).
"""
