"""leafline: documents as relations of ordered text operators, on Spark."""
