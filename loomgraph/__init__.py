"""Entity-graph and text analytics expressed as Spark DataFrame operators."""
