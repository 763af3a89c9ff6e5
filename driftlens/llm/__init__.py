"""Corpus operators for training data: one module per operator, their registered queries in `queries`."""
