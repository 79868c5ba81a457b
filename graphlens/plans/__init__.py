"""How plans are bound to tables and cut into stages."""
