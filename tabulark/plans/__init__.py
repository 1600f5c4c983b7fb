"""Driver-side decisions and the experiment loop built from the operators."""
