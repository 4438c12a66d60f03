"""weftcloud: a Spark-native engine for sequenced 3-D point data.

Bronze batches are appended, everything else is derived with DataFrame operations.
"""
