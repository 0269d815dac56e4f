"""Role binding and the registered queries with their SQL oracles."""
