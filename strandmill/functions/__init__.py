"""Column functions: everything about a read that built-in expressions can say."""
