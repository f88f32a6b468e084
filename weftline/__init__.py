"""weftline: evidence-table analytics on PySpark."""
