"""Operations of a large-scale training-data pipeline: one module per operator.

Every operator takes DataFrames and returns DataFrames. Nothing else in the library imports this
subpackage; `vigil.llm.registry` holds the registered queries.
"""
