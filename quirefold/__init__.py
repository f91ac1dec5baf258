"""Reading-order reconstruction and text-pipeline operators as Spark plans."""
