"""Column functions: Column -> Column, all of them built from Spark's own."""
