"""graphlens: analytics over code graphs as PySpark DataFrame operators."""
