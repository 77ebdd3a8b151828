"""Jobs that build the stored datasets and the catalog of runnable queries."""
