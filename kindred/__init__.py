"""Record linkage on Spark: normalisation, blocking, pair features, scoring, assignment and evaluation."""
