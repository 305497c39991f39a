"""Physical-plan helpers shared by the operators."""
