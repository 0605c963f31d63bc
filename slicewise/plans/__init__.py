"""Queries of the engine over views derived from the driver's tables, with their SQL twins."""
