"""Regional supply-and-demand analytics written as plain Spark DataFrame functions."""
