"""Quarry: a retrieval and corpus-analytics engine made of DataFrame operators."""
