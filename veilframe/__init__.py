"""Privacy and LLM-usage analytics as Spark DataFrame transformations."""
