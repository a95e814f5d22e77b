"""PySpark library of batch jobs for sports-opportunity analytics."""
