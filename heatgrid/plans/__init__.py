"""Compositions of operators: scenes to features, features to a dataset, dataset to models, models to plans."""
