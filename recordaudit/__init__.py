"""Record Audit: build, clean and judge synthetic records of a rare class with Spark DataFrames."""
