"""From rule text to plans: the expression language, the rule language, and their compilation to columns."""
