"""assaykit: evaluation metrics, sampling, retrieval and audits as Spark plans."""
