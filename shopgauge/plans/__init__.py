"""Query plans: the layered model, the named-query registry, bundles, oracle SQL."""
