"""Table operators: joins, aggregates, labels and ranks. DataFrame in, DataFrame out."""
