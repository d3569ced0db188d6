"""Training-data operators: one module per operator, each usable on any table with an id and a text (or vector) column."""
