"""An analytics engine for code and conversation memory, and for training data, on Spark."""
