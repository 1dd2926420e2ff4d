"""Training-data operators: cleaning, scoring, near-duplicate removal, mixing and packing of text.

Nothing outside this subpackage imports it, except the guarded hook in ``__spark_entry__.py`` and the
pipeline script at the repository top.
"""
