"""Package streaming of sparkloom."""
