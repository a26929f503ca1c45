"""Column functions: text normalisation and scoring."""
