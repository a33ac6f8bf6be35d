"""brindle: trajectory and evaluation analytics expressed as Spark DataFrame plans."""
