"""Training-data operators: deduplication, packing, decontamination, scoring,
secret and quality screening, token output.  Nothing else in the library
imports this subpackage."""
