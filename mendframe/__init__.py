"""mendframe: a PySpark-native analytics engine for verified-repair and code-optimisation corpora."""
