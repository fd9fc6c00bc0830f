"""Column functions: exact decimals, byte cuts, histogram bounds and order-book levels."""
