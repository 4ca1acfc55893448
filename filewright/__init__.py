"""File and document intelligence as lazy PySpark DataFrame operators."""
