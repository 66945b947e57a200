"""Analytics over agent sessions and the notes distilled from them, on Spark."""
