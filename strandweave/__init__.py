"""Analytics over large directed contact graphs and the time series recorded around them, on Spark."""
