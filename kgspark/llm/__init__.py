"""Training-data operators over corpora: one module per operator, one registry of queries."""
