"""Query plans: the named queries over tables and their SQL oracles."""
