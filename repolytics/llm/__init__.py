"""Operations of a training-data pipeline over tables of documents and pages.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`repolytics.llm.queries` holds the thin ``opN_<name>`` queries
over the given tables and their SQL.
"""
