"""Operators for preparing text corpora: each module is one operator, `catalog` registers them."""
