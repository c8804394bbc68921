"""Document intelligence on Spark: text to evidence-backed facts, as DataFrame operators."""
