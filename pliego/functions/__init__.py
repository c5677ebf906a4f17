"""Column functions and fixed tables of the notice domain."""
