"""Analytics over tenant-partitioned, versioned records, expressed as Spark DataFrames."""
