"""Count forecasting over two-sided events, on Spark."""
