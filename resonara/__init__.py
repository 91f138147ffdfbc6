"""resonara: near-duplicate consolidation of array-valued records, Spark first.

``operators``, ``functions``, ``sources``, ``plans`` and ``streaming`` make up
the engine.  The text-corpus operators live in a subpackage of their own which
nothing here imports.
"""

__version__ = "0.1.0"
