"""Portfolio simulation, metrics and research runs."""
