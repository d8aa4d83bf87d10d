"""Package functions of sparkloom."""
