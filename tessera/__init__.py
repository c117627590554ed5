"""tessera: spatial point-process analytics as Spark plans."""
