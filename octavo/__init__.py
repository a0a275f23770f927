"""octavo: byte, signal and stream analytics on PySpark DataFrames."""
