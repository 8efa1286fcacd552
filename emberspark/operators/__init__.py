"""DataFrame -> DataFrame operators of the hazard engine."""
