"""Training-data operators: operators over a documents table, and one over embeddings.

Nothing outside this folder imports it.  ``lumen.llm.entry`` registers the
queries; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
