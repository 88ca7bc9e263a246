"""gradeloom: a Spark-native engine for building, auditing, scoring and comparing text corpora."""
