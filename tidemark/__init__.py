"""tidemark: lakehouse order analytics, data quality, governance and catalog jobs on Spark.

Every public function takes and returns DataFrames or Columns; nothing here
starts a session, collects a table or keeps state of its own.
"""

__version__ = "0.1.0"
