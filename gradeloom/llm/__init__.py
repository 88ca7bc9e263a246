"""Training-data operators: one module per operator, their contract queries in :mod:`gradeloom.llm.queries`."""
