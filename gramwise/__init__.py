"""gramwise: statistical estimation on Spark DataFrames.

Every estimator is a few distributed aggregates (moments of a table) followed by a small solve; every
prediction is a projection. Rows stay on the executors.
"""
