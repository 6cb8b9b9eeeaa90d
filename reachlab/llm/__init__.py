"""Operators for large training-data pipelines.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; the
package and ``tests/llm`` can be removed without touching the rest.
"""
