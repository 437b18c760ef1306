"""partweave: hierarchical-part analytics and corpus preparation as Spark jobs."""
