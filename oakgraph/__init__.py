"""oakgraph: content-addressed object graphs and corpus preparation on Spark."""
