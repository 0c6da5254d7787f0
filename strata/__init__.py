"""strata: governed warehouse history on Spark."""
