"""DataFrame operators: topic baseline and adjustment, reports, dataset
preparation, encoding, scorers, prediction."""
