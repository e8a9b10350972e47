"""Document reconstruction and training-data operators on PySpark."""
