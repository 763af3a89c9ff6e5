"""driftlens: out-of-distribution analytics for text models, written as Spark jobs."""
