"""Sources, sinks, and tables in the shapes that the operators take."""
