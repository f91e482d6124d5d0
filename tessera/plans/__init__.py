"""Plan building blocks: written intermediates, skew-proof ranking, size-checked broadcasts."""
