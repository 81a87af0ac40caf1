"""Sources: source trees, configuration files, and the test tables as a graph."""
