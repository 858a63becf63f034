"""Column functions: normalisers, classifiers, extractors and evidence kernels."""
