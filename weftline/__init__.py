"""weftline: data workflows as graphs of named nodes, run as Spark plans."""
