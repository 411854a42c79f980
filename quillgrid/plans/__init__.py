"""The Vault facade and the query catalogue."""
