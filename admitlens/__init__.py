"""Set-oriented admissions analytics on Apache Spark DataFrames."""
