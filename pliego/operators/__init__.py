"""Dataflow operators: DataFrame in, DataFrame out, with columns and fixed dates as parameters."""
