"""Training-data operators tagged llm; nothing outside this folder imports it."""
