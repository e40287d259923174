"""Building plans: streams, conditions, ordering."""
