"""Package sources of sparkloom."""
