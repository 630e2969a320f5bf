"""Operators of a training-data pipeline: classifiers, chat formatting, fingerprints,
line and near-duplicate removal, token files, decontamination, BPE and licence scans.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
