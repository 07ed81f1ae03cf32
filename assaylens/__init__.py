"""assaylens: response / biomarker association analysis as Spark DataFrame jobs."""
