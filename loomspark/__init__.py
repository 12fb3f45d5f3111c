"""Analytics over append-only conversation and revision logs, expressed as Spark DataFrame plans."""
