"""Sources, sinks and the derivation of the customer table from the test data."""
