"""Column expressions shared by the planner and the operators."""
