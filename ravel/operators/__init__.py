"""DataFrame operators: islands, range joins, signatures, clusters, genotypes, alignment, evaluation."""
