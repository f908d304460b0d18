"""A PySpark engine that cleans, de-duplicates and audits large catalogues."""
