"""River-gauge analytics and corpus preparation on PySpark."""
