"""codelattice: a PySpark-native code-graph analytics engine."""
