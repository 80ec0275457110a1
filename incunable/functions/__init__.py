"""Column expressions: text normalisation, passes, classification, splitting."""
