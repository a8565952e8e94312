"""Training-data operators: ten stand-alone components and the queries that apply them."""
