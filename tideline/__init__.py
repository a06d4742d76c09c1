"""tideline: ordered, versioned key/value analytics expressed as Spark plans."""
