"""A PySpark-native analytics engine: Parquet directories as tables, relational operators, TPC-H-shaped queries."""
