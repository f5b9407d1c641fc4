"""DataFrame operators on change logs and the state that they lead to."""
