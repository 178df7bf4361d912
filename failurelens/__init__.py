"""failurelens: Spark-native analytics over code-generation failure data.

Sub-packages:
  sources    readers for problems, logs, stores and fixtures derived from tables
  functions  Column-returning expressions (parsing, text, pass@k, vectors)
  operators  DataFrame -> DataFrame building blocks (store, clustering, buffer...)
  plans      registered end-to-end queries and their DuckDB oracle SQL
  streaming  Structured Streaming versions of the incremental operators
"""

__version__ = "0.1.0"
