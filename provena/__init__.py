"""Evidence-first analytics on Spark: DataFrame operators that keep every result tied to its source row."""
