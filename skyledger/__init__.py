"""Calendar, text and record analytics as Spark DataFrame operators."""
