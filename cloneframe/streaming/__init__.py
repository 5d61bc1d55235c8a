"""Running versions of the monotone aggregates: counts that only grow, so each micro-batch adds to them."""
