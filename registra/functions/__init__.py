"""Column expressions: labels, dates, prices, URLs and text clean-up."""
