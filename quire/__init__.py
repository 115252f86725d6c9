"""quire: corpus preparation and evaluation jobs expressed as Spark DataFrame plans.

Operators are functions ``(DataFrame, ...) -> DataFrame``.  Training, in-place
lookups (a vocabulary of checked size) and tables written to the shared folder
run jobs when called; everything else stays lazy.
"""

__version__ = "0.2.0"
