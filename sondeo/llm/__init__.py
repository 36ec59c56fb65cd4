"""Training-data operators: language ID, near-duplicates, decontamination, PII,
tokenisation, quality rules and scores, HTML extraction, chat formatting and
repeated-substring removal.  Nothing outside this subpackage imports it."""
