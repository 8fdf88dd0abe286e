"""plumbline: multiple-choice evaluation analytics as Spark DataFrame plans."""
