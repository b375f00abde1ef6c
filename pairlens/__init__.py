"""pairlens: paired-comparison and ranking audits, and corpus preparation, as Spark jobs."""
