"""Analytics over aircraft datalink messages, declared as Spark DataFrame plans."""
