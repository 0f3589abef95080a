"""Business-intelligence data preparation and analysis on PySpark DataFrames."""
