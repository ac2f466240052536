"""DataFrame operators: each is a function DataFrame -> DataFrame."""
