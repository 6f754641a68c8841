"""Analytics of sales documents at catalogue scale, on Spark."""
