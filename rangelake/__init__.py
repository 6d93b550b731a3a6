"""Analytics over range-partitioned key/value records on Spark DataFrames."""
