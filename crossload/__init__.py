"""Records moved between systems of record, as whole-table Spark jobs."""
