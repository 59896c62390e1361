"""Statement reconciliation and corpus preparation as Spark DataFrame transformations."""
