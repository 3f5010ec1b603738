"""Tables, files, phase stores and generated networks."""
