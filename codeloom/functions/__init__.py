"""Column functions: folds, globs, tokens, paths."""
