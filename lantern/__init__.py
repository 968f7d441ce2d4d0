"""lantern: evidence timelines and corpus preparation as composable Spark DataFrame queries."""
