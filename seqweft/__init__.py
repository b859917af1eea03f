"""A PySpark-native engine for read, window and signal data: lazy DataFrame operators over any table."""
