"""polyglint: localization analytics and training-data preparation on PySpark."""
