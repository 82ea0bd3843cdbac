"""Planning on the driver: hypergraphs of joins, and the decision-support queries."""
