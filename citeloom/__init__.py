"""citeloom: corpus-scale citation analytics expressed as Spark plans."""
