"""Package operators of sparkloom."""
