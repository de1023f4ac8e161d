"""Code facts as DataFrames: entities, relations and evidence computed with Spark SQL."""
