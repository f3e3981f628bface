"""Training-data operators: tokenizing, near duplicates, decontamination, scans, exact search."""
