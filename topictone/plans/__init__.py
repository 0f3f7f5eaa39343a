"""Composed plans: the topic analysis, training, and the registered queries."""
