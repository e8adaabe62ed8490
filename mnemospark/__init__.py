"""mnemospark: vector, graph, text and event-log analytics as Spark DataFrames."""

__version__ = "0.1.0"
