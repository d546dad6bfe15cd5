"""Spark-native analytics of spatial evidence and simulated access.

``functions`` holds column expressions, ``operators`` joins, aggregates and loops
over DataFrames, ``sources`` readers and writers, ``plans`` whole queries over
driver tables, ``streaming`` the incremental form of the counts.
"""
