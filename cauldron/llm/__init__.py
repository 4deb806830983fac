"""Training-data operators (``cauldron.llm``); nothing else in the library imports this package."""
