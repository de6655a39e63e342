"""plumbline: data-quality checks and reconciliation as Spark plans."""
