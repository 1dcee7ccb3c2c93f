"""Graph construction, personalised PageRank, vector algebra, compute order and co-occurrence."""
