"""Reading traces, and reading and writing prediction results."""
