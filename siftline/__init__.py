"""Hybrid retrieval and corpus analytics as composable DataFrame transformations."""
