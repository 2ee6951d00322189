"""cellwise: Spark-native analytics over sparse activation tables (row, group, cell, item, weight)."""
