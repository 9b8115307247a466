"""quire: PDF-corpus and text-corpus analytics expressed as Spark plans."""
