"""Operations of a training-data pipeline: ten operators, their queries and their SQL.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
