"""Reading and writing ledgers, change feeds and test tables."""
