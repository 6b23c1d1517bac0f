"""Column -> Column scalar expressions."""
