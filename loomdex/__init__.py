"""A document-intelligence engine on the PySpark DataFrame API."""
