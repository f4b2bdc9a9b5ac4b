"""Training-data operators: tokens, extraction, quality, language, dedup, privacy.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; models and vocabularies are the only things that travel through the
driver, and both are bounded by documented parameters.
"""
