"""Training-data operators: ten self-contained jobs over text tables.

Nothing outside this subpackage imports it.
"""
