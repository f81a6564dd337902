"""Query plans over the corpus tables: one function per registered query plus the
equivalent SQL used as an independent oracle."""
