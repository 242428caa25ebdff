"""protolith: Protocol Buffers analytics and training-data preparation on PySpark."""
