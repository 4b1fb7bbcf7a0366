"""tallyloom: Spark operators for typed-question datasets and their evaluation."""
