"""Training-data operators: each is a Spark job over documents, pages or vectors."""
