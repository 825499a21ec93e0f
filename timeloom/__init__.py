"""Timeline analytics on Spark: intervals, points and texts observed along many independent timelines."""
