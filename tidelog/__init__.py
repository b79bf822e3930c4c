"""tidelog: durable-log analytics on PySpark."""
