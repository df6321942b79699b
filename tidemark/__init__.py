"""Point-in-time disclosure analytics and training-data operators on PySpark."""
