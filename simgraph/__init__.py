"""simgraph: similarity joins, entity resolution and graph clustering as Spark plans."""
