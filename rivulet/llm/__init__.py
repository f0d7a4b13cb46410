"""Training-data operators: packing, chat formatting, language ID, deduplication, extraction, filters and PII.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to DataFrames;
``rivulet.llm.queries`` applies them to the standard tables.
"""
