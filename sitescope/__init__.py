"""Business-website intelligence on PySpark."""
