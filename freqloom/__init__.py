"""freqloom: concept-frequency analytics and corpus preparation on PySpark."""
