"""Training-data operators: search, packing, dedup, token counts, encoded
output, language models, language ID, toxicity and decontamination.

Nothing outside this subpackage imports it, except the guard in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
