"""Readers and writers of graphs, ranks, orders, vocabularies and co-occurrence matrices."""
