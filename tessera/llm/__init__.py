"""Operators of a training-data pipeline: chat formatting, quality, language,
toxicity, line and document dedup, binary token files, LM scoring,
decontamination and packing.  Nothing outside this folder imports it."""
