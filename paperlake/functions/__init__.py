"""Column functions: strings, numbers, formulas, JSON. Built-in expressions but for Unicode normalisation."""
