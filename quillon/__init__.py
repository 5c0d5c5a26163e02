"""quillon: Spark-first analytics over corpora of technical documents."""
