"""Training-data operators: language, tokens, scores, quality, archives, mixing,
sharding and near-duplicates.  Nothing else in the library imports this subpackage."""
