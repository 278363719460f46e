"""Set-at-a-time hybrid document search and answer-quality analytics on Spark."""
