"""Web-asset inventory, knowledge graph and read-only SQL on PySpark."""
