"""Table-level Spark operators that turn web captures and posts into a knowledge table."""
