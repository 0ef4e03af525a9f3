"""lattice: a PySpark-native engine for property graphs and corpora."""
