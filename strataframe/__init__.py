"""strataframe: framing, exporting and re-shaping of versioned collections, graphs and layered texts on Spark."""

__version__ = "0.1.0"
