"""evidra: evidence-grounded evaluation analytics as Spark plans."""
