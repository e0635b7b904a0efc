"""Spark-native building of fine-tuning conversation sets for many languages at once.

Every operator takes and returns DataFrames or Columns.  Calls to a teacher
model stay outside: a job ends by writing a *request* table and the next job
begins by reading a *response* table keyed by ``req_id``.
"""
