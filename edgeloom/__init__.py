"""edgeloom: a Spark-native dynamic-graph engine with corpus operators beside it."""
