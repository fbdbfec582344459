"""corpusloom: corpus building and analysis as PySpark DataFrame operators."""
