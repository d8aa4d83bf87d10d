"""Package plans of sparkloom."""
