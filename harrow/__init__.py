"""harrow: fleet telemetry analytics on Spark.

Vehicle-bus frames, GPS reports, modem, counter, probe and spectrum messages
come in as DataFrames (or streams) and leave as typed signals, statistics,
events, tracks and documents. Everything is a DataFrame transformation; see
README.md for the map from task to function.
"""

__version__ = "0.1.0"
