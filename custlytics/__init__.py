"""custlytics: customer and transaction analytics as plain Spark DataFrame functions."""
