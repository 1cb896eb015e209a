"""DataFrame operators, one module per family (see README operator table)."""
