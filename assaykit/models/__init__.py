"""Fitted models: MLlib where it has the model, jobs over aggregates where it has not."""
