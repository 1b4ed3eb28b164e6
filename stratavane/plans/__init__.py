"""Programs: syntax, checks, rule plans and their evaluation to a fixpoint."""
