"""Composed plans: diagnostics, evaluation, reporting, spatial work, training."""
