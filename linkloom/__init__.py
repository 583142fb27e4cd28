"""linkloom: record linkage and corpus preparation as composable PySpark transformations."""
