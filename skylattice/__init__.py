"""Station-network analytics as PySpark DataFrame transformations."""
