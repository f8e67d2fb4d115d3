"""Column functions: text normalisation and polygon maths, all as built-in expressions."""
