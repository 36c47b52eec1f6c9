"""rankloom: grouped evaluation and ranking of aligned sequence pairs as Spark jobs."""
