"""DataFrame operators: relational steps, ranking, metrics, retrieval, features, embeddings and learners."""
