"""Scoring of streams: the same projections, fed by files as they arrive."""
