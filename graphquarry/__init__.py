"""graphquarry: a PySpark-native engine for linked, hierarchical data."""
