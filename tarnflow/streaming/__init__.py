"""Empty on purpose: a graph is a bounded input that is read as a whole, so there is no stream to be faithful to."""
