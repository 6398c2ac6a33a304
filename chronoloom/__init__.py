"""chronoloom: timed-text, tree, graph and activity analytics as Spark DataFrame operators."""
