"""ladle: retail and restaurant analytics as plain Spark DataFrame operators."""
