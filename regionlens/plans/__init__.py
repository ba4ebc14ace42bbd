"""Whole queries: the batch build of the facts and marts, and the questions asked of them."""
