"""Training-data operators: one module per operator, thin registered queries in ``queries``."""
