"""corpusloom: a PySpark-native analytics engine for research corpora."""
