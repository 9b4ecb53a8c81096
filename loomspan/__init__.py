"""loomspan: a PySpark-native library for activity, ledger, stock and document analytics."""
