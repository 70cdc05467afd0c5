"""Entity resolution and corpus processing as Spark DataFrame operators."""
