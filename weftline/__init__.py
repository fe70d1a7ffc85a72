"""weftline: text, link and sentiment analytics as declarative Spark plans."""
