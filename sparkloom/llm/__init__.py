"""Training-data operators: tokenizing, scanning, matching and search over whole tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
