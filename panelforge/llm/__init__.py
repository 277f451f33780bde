"""Training-data operators: toxicity, packing, BPE, media, scans, dedup, joins and mixing."""
