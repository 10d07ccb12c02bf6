"""drawlog: Spark jobs over logs of vector-drawing events."""
