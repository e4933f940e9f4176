"""flowkit: packet tables to audited time-series datasets, as Spark DataFrame transformations."""
