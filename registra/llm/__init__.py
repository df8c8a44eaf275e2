"""Training-data operators: language identification, de-duplication, decontamination, search, archives, scoring, tokenizing."""
