"""The phases of an analysis, and the registered queries with their SQL."""
