"""latticework: a PySpark-native engine for numeric grids, projections and the tables around them."""
