"""Whole jobs composed of the operators: preprocessing, training, experiments, evaluation."""
