"""Column builders: values and errors, scalar functions, criteria, number formats, cell references."""
