"""Analytics on short numeric series and ordered outcomes, native to PySpark."""
