"""DataFrame operators: profile, routing, groups, evaluation, composition, export."""
