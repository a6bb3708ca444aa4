"""Review analytics and recommendation as PySpark DataFrame operators."""
