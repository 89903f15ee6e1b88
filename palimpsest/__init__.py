"""Set-at-a-time retrieval, lifecycle and data-quality analytics over bi-temporal entry tables."""
