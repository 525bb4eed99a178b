"""visitloom: Spark jobs over collections of visit documents."""
