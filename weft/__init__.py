"""Multi-way joins, subgraph patterns and relational primitives on Spark."""
