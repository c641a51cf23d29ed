"""Training-data operators: language ID, chat formatting, dedup, LM scoring, packing, decontamination, media, BPE.

Nothing outside this subpackage imports it.
"""
