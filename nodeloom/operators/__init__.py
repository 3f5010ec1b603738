"""Graph, feature, scoring, simulation and model operators over DataFrames."""
