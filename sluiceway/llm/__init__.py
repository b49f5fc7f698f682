"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames.  Nothing outside this subpackage
imports it; :mod:`sluiceway.llm.registry` names the queries built from it.
"""
