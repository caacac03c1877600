"""quadrill: temporal-knowledge-graph analytics expressed as Spark DataFrame plans."""
