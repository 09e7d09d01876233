"""Corpusloom: corpus-lexicon jobs written as Spark DataFrame plans."""
