"""Values and operators of the dialect as Column expressions."""
