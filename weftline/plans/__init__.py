"""Composed jobs: from seeds and texts to the training table."""
