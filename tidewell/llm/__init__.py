"""Training-data operators: packing, language identification, token files, archives, de-duplication and search."""
