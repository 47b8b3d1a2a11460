"""Pure column functions: no shuffles, no actions, usable on batch and streaming DataFrames."""
