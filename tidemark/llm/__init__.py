"""Training-data operators: one module per operator, plus their registered queries."""
