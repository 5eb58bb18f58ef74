"""Operations of a training-data pipeline on Spark tables.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame plus the names of the columns it reads, ignores all other columns
(so clashing names do no harm) and states in its docstring what nulls, empty
texts, ties and repeated rows give.
"""
