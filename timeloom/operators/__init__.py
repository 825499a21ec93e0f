"""Operators over timelines: DataFrame in, DataFrame out. Times are whole milliseconds; every list has its own order column."""
