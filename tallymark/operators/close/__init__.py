"""Closing a period: exposure, materiality, blockers, carry-forward, predictions, reviews, scenarios."""
