"""lexiscope: analytics over phrase-mined text corpora, expressed as Spark plans."""
