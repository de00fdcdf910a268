"""Training-data operators: language id, dedup, decontamination, token ids, WARC, chat."""
